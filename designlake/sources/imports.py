"""Untrusted JSON: parsed against a schema, split into rows that hold and rows set aside with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most characters of one record.
MOST_CHARS = 32_000_000
HARVEST = "url string, title string, nodes array<struct<tag:string,text:string>>"


def checked(df: DataFrame, column: str, schema: str = HARVEST, most: int = MOST_CHARS) -> DataFrame:
    """df with harvest (the parsed record, null if it does not hold) and reason (why not, else null)."""
    parsed = F.when(F.length(column) <= most, F.from_json(column, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    d = df.withColumn("harvest", parsed)
    reason = (
        F.when(F.col(column).isNull(), "empty")
        .when(F.length(column) > most, "too large")
        .when(F.col("harvest._corrupt").isNotNull(), "not JSON")
        .when(F.coalesce(F.col("harvest.url"), F.lit("")) == "", "no address")
        .when(F.coalesce(F.size("harvest.nodes"), F.lit(0)) <= 0, "no measurable content")
    )
    d = d.withColumn("reason", reason)
    return d.withColumn("harvest", F.when(F.col("reason").isNull(), F.col("harvest").dropFields("_corrupt")))
