"""Where intermediate tables go, and small helpers that every operator here shares."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words, as a regular expression class.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="designlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs start from files that outlive executors."""
    path = table_path(df.sparkSession, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    _written[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that cut() wrote; only for tables whose every reader has been cut itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(_written.pop(t))
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have (names are compared without case)."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name += "_"
    return name


def bound(df: DataFrame, name: str, value) -> DataFrame:
    """withColumn whose value is computed once per row: the optimizer copies no part of it into later steps."""
    return df.withColumn(name, F.explode(F.array(value)))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def word_array(text):
    """Words of a text column as an array, empty for a null or blank text."""
    trimmed = F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, rf"{BLANK}+"))
