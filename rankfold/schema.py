"""Column lists and schemas of the four table shapes the library passes around."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and level texts that stored tables already use.
RESOLVED = ["Fully Paid", "Charged Off"]
POSITIVE = "Charged Off"
NUMERIC_RAW = [
    "loan_amnt", "int_rate", "installment", "annual_inc", "dti", "fico_range_high", "open_acc",
    "revol_bal", "revol_util", "total_acc", "pub_rec", "delinq_2yrs", "inq_last_6mths", "mort_acc",
]
NUMERIC_DERIVED = ["emp_length", "credit_history_years", "term_months"]
NUMERIC = NUMERIC_RAW + NUMERIC_DERIVED
CATEGORICAL = ["purpose", "home_ownership", "addr_state", "verification_status"]
FEATURES = NUMERIC + CATEGORICAL
RAW_COLUMNS = [
    "id", "loan_status", "issue_d", "term", "emp_length", "earliest_cr_line", *NUMERIC_RAW, *CATEGORICAL,
]
POST_ORIGINATION = [
    "out_prncp", "out_prncp_inv", "total_pymnt", "total_pymnt_inv", "total_rec_prncp", "total_rec_int",
    "total_rec_late_fee", "recoveries", "collection_recovery_fee", "last_pymnt_d", "last_pymnt_amnt",
    "next_pymnt_d", "last_credit_pull_d", "last_fico_range_high", "last_fico_range_low",
]
UNKNOWN_LEVEL = "Desconocido"
RARE_LEVEL = "infrecuente"
SENTINEL = -1.0


def text_schema(columns: list[str]) -> T.StructType:
    """Schema of a raw text table: every column a nullable string."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])

