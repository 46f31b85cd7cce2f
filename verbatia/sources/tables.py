"""Static tables and the cached corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frequency_table(spark: SparkSession, path: str) -> DataFrame:
    """(word, zipf) of a tab-separated file with comment lines; a word that is not in it has frequency 0 where it is joined."""
    return spark.read.csv(path, sep="\t", comment="#", schema="word string, zipf double").filter("word is not null")


def cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON documents that may span lines."""
    return spark.read.schema(schema).json(path, multiLine=True)


def articles(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def save_corpus(units: DataFrame, root: str, fetched_at: float) -> None:
    """A new version of the corpus; readers see it only when it is complete, since the pointer is written last."""
    version = uuid.uuid4().hex
    units.write.parquet(f"{root}/versions/{version}")
    row = units.sparkSession.createDataFrame([(version, float(fetched_at))], "version string, fetched_at double")
    row.coalesce(1).write.mode("append").parquet(f"{root}/pointers")


def load_corpus(spark: SparkSession, root: str) -> tuple[DataFrame, float] | None:
    """The newest complete version and when it was fetched; None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointers")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    newest = spark.read.schema("version string, fetched_at double").parquet(f"{root}/pointers").orderBy(F.desc("fetched_at"), F.desc("version")).first()
    return (spark.read.parquet(f"{root}/versions/{newest.version}"), newest.fetched_at) if newest else None


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in a shared folder: read as often as wanted, computed once."""
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
