import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from rankfold.session import drop_scratch, get_session

    session = get_session(master="local[8]", conf={
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def scores(spark):
    """3000 rows; a third share one score of `a`, `b` is continuous, `c` has three values."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    n = 3000
    y = (rng.random(n) < 0.3).astype(int)
    a = np.where(rng.random(n) < 1 / 3, 0.4, np.round(rng.random(n) * 0.7 + y * 0.2, 2))
    frame = pd.DataFrame({"id": [f"r{i}" for i in range(n)], "y": y, "a": a, "b": rng.normal(y * 0.5, 1.0),
                          "c": rng.integers(0, 3, n) / 2.0})
    return spark.createDataFrame(frame).cache(), frame
