"""JSON lines: lenient scan, sorted sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..operators.numbering import in_order


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """Rows of one JSON object a line (only \\n ends a line); a missing path is an empty table."""
    try:
        return spark.read.schema(schema).option("lineSep", "\n").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_jsonl(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One object a line with sorted keys; with order (a total one), files whose names follow it: end to end they are the same bytes for the same rows."""
    text = rows.select(*([F.col(c) for c in order] if order else []), F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns))), {"ignoreNullFields": "false"}).alias("_json"))
    if order:
        text = in_order(text, [F.col(c) for c in order])
    text.select(F.col("_json").alias("value")).write.mode("overwrite").text(path)
