"""Tokens with code-point offsets, and the segments they form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatia.functions.normalize import GENERIC, Profile

#: Bytes of an Arrow batch of words or their lengths, unless the session says otherwise.
ARROW_BYTES = "4m"


def tokenize(df: DataFrame, keys: list[str], text: str = "text", profile: Profile = GENERIC) -> DataFrame:
    """Rows (keys, tok, raw, fold): maximal runs of letters and marks, in order."""
    raw = F.regexp_extract_all(F.col(text), F.lit(profile.token), F.lit(0))
    out = df.select(*keys, F.posexplode(raw).alias("tok", "raw"))
    out = out.withColumn("tok", F.col("tok").cast("long"))
    return out.withColumn("fold", profile.folded(F.col("raw")) if profile.name != "generic" else F.lower("raw"))


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, ARROW_BYTES)


def running_sums(numbers: Column) -> Column:
    """The running sums of an array of integers, in one pass."""

    def sums(arrays: pa.Array) -> pa.Array:
        at = arrays.offsets.to_numpy()
        through = np.concatenate(([0], np.cumsum(arrays.values.to_numpy(zero_copy_only=False), dtype="int64")))
        own = through[1:] - np.concatenate((np.zeros(at[0], "int64"), np.repeat(through[at[:-1]], np.diff(at)), np.zeros(len(through) - 1 - at[-1], "int64")))
        return pa.ListArray.from_arrays(arrays.offsets, pa.array(own))

    return F.arrow_udf(sums, "array<long>")(numbers)


def word_arrays(df: DataFrame, keys: list[str], text: str = "text", profile: Profile = GENERIC) -> DataFrame:
    """(keys, raws, gaps): the words of each text, and the text before each, as arrays of one length; nulls for a null text."""
    raw = F.regexp_extract_all(F.col(text), F.lit(profile.token), F.lit(0))
    rows = df.select(*keys, raw.alias("raws"), F.split(F.col(text), profile.token).alias("gaps"))
    return rows.withColumn("gaps", F.slice("gaps", F.lit(1), F.size("raws")))


def with_ends(arrays: DataFrame) -> DataFrame:
    """Rows of ``word_arrays`` with ``ends``, the code-point offsets at which words end."""
    bound_batches(arrays.sparkSession)
    return arrays.withColumn("ends", running_sums(F.zip_with("gaps", "raws", lambda g, r: F.length(g) + F.length(r))))


def tokenize_with_gaps(df: DataFrame, keys: list[str], text: str = "text", profile: Profile = GENERIC) -> DataFrame:
    """Rows (keys, tok, gap, raw, fold): tokens and the text between them and their predecessor."""
    pair = F.posexplode(F.arrays_zip("gaps", "raws")).alias("tok", "t")
    out = word_arrays(df, keys, text, profile).select(*keys, pair).select(*keys, F.col("tok").cast("long").alias("tok"), F.col("t.gaps").alias("gap"), F.col("t.raws").alias("raw"))
    return out.withColumn("fold", profile.folded(F.col("raw")) if profile.name != "generic" else F.lower("raw"))


def tokenize_with_offsets(df: DataFrame, keys: list[str], text: str = "text", profile: Profile = GENERIC) -> DataFrame:
    """Tokens with their code-point offsets [start, end) and the text between them and their predecessor.

    Offsets are the running sums of the lengths of gaps and tokens, made within each row, so that no tokens are shuffled.
    """
    pair = F.posexplode(F.arrays_zip("gaps", "raws", "ends")).alias("tok", "t")
    out = with_ends(word_arrays(df, keys, text, profile)).select(*keys, pair).select(*keys, F.col("tok").cast("long").alias("tok"), F.col("t.gaps").alias("gap"), F.col("t.raws").alias("raw"), F.col("t.ends").alias("end"))
    out = out.withColumn("start", F.col("end") - F.length("raw"))
    return out.withColumn("fold", profile.folded(F.col("raw")) if profile.name != "generic" else F.lower("raw"))


def segments(tokens: DataFrame, keys: list[str], allowed: str = r"\A[ \t,;]*\z") -> DataFrame:
    """Runs of tokens with nothing but allowed characters between them: (keys, seg, first, last)."""
    broken = F.when((F.col("tok") > 0) & F.col("gap").rlike(allowed), 0).otherwise(1)
    numbered = tokens.withColumn("seg", F.sum(broken).over(W.partitionBy(*keys).orderBy("tok")) - 1)
    return numbered.groupBy(*keys, "seg").agg(F.min("tok").alias("first"), (F.max("tok") + 1).alias("last"))
