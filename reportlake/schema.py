"""The data model: labels, logical schemas and the helper that makes a frame conform to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the five labels in order, JSON key to column name
LABELS = {
    "focal_epileptiform_activity": "Focal Epi",
    "generalized_epileptiform_activity": "Gen Epi",
    "focal_non_epileptiform_activity": "Focal Non-epi",
    "generalized_non_epileptiform_activity": "Gen Non-epi",
    "abnormality": "Abnormality",
}
CATEGORIES = list(LABELS.values())
#: Text of a reason that the annotator left out.
NO_REASON = "No Explanation Given"
#: Text of an instance without a reason in the audit's reports.
NO_REASON_GIVEN = "(No explanation provided)"
#: Names under which the id column may arrive, the preferred one first.
ID_NAMES = ("Hashed_ReportURN", "Hashed ID", "Hashed_ID", "report_id")

REPORTS = T.StructType([T.StructField("report_id", T.StringType()), T.StructField("report", T.StringType()), T.StructField("pos", T.LongType())])
RAW_RESULTS = T.StructType([T.StructField(c, T.StringType()) for c in ("report_id", "classifications", "explanations")])
ERRORS = T.StructType([T.StructField(c, T.StringType()) for c in ("report_id", "error_type", "error_message", "problematic_json")])
LONG = T.StructType([T.StructField("report_id", T.StringType()), T.StructField("category", T.StringType()), T.StructField("decision", T.IntegerType()), T.StructField("reason", T.StringType())])


def conform(df: DataFrame, schema: T.StructType, renames: dict[str, str] | None = None) -> DataFrame:
    """df with exactly schema's columns: renamed, cast, and typed nulls for what is missing."""
    back = {new: old for old, new in (renames or {}).items() if old in df.columns}
    return df.select([(F.col(f"`{back.get(f.name, f.name)}`") if back.get(f.name, f.name) in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def id_column(columns: list[str]) -> str:
    """Which column holds the id; raises if none does."""
    for name in ID_NAMES:
        if name in columns:
            return name
    raise ValueError(f"no id column among {columns}; known names: {', '.join(ID_NAMES)}")


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require(df: DataFrame, required: list[str]) -> None:
    """Raise KeyError for columns that an operator can't do without."""
    if missing := missing_columns(df, required):
        raise KeyError(f"missing columns: {missing}")


def has_all_labels(df: DataFrame) -> bool:
    """Only a frame with every label can be evaluated."""
    return not missing_columns(df, CATEGORIES)
