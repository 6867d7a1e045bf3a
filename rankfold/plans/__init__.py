"""Queries of the catalogue on the star-schema tables, each with SQL for the same result."""

from rankfold.plans import association, comparison, features, fitting, profile, ranking, reporting, splitting, storage  # noqa: F401
from rankfold.plans.catalog import REGISTRY, SQL  # noqa: F401
