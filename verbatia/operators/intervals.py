"""Interval operators inside a key: overlap joins, greedy disjoint choice, as-of joins, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner", a_range=("s", "e"), b_range=("s2", "e2")) -> DataFrame:
    """Rows of a and b (under other range names) with a common key whose half-open ranges overlap; left_anti and left_semi too."""
    cond = (F.col(f"a.{a_range[0]}") < F.col(f"b.{b_range[1]}")) & (F.col(f"b.{b_range[0]}") < F.col(f"a.{a_range[1]}"))
    for k in on:
        cond = (F.col(f"a.{k}") == F.col(f"b.{k}")) & cond
    joined = a.alias("a").join(b.alias("b"), cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.select("a.*", *[f"b.{c}" for c in b.columns if c not in on])


def with_overlaps(a: DataFrame, b: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of a (s, e) with a column that tells whether a range of b with their key overlaps theirs; a is read once."""
    ranges = b.groupBy(key).agg(F.collect_list(F.struct("s", "e")).alias("_ranges"))
    over = F.exists("_ranges", lambda x: (x["s"] < F.col("e")) & (F.col("s") < x["e"]))
    return a.join(ranges, key, "left").withColumn(name, F.coalesce(over, F.lit(False))).drop("_ranges")


def greedy_disjoint(df: DataFrame, key: str, order: list[Column], s: str = "s", e: str = "e") -> DataFrame:
    """Rows kept when taken in order and dropped if they overlap a kept row of the key.

    ``order`` are columns that sort ascending; a key's rows, the findings of one document, are one array.
    """
    cols = [c for c in df.columns if c != key]
    row = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], *cols)
    out = df.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    empty = F.filter("rows", lambda x: F.lit(False))
    kept = F.aggregate("rows", empty, lambda acc, x: F.when(F.exists(acc, lambda k: (k[s] < x[e]) & (x[s] < k[e])), acc).otherwise(F.concat(acc, F.array(x))))
    return out.select(key, F.inline(kept)).select(key, *cols)


def block(at: Column, within: int) -> Column:
    """The block of a key that holds a place; what lies at most ``within`` apart is in the same block or in neighbours."""
    return F.floor(at / max(within, 1))


def blocked(spans: DataFrame, at: Column, within: int, side: int) -> DataFrame:
    """Spans once for the block of ``at`` and once for its neighbour on one side (1 or -1), in a column ``_block``."""
    here = block(at, within)
    return spans.withColumn("_block", F.explode(F.array(here, here + side)))


def asof_forward(spans: DataFrame, points: DataFrame, key: str, within: int, e: str = "e", at: str = "at", value: str = "ref") -> DataFrame:
    """Each span with the first point that starts at or after its end, at most ``within`` away, or null."""
    near = blocked(spans, F.col(e), within, 1).alias("a").join(points.withColumn("_block", block(F.col(at), within)).alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._block") == F.col("b._block")) & (F.col(f"b.{at}") >= F.col(f"a.{e}")) & (F.col(f"b.{at}") <= F.col(f"a.{e}") + within), "left")
    cols = [f"a.{c}" for c in spans.columns]
    return near.groupBy(*cols).agg(F.min_by(f"b.{value}", f"b.{at}").alias(value), F.min(f"b.{at}").alias(at))


def asof_backward(spans: DataFrame, points: DataFrame, key: str, within: int, s: str = "s", at: str = "at", value: str = "ref") -> DataFrame:
    """Each span with the last point that ends at or before its start, at most ``within`` away, or null."""
    near = blocked(spans, F.col(s), within, -1).alias("a").join(points.withColumn("_block", block(F.col(at), within)).alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._block") == F.col("b._block")) & (F.col(f"b.{at}") <= F.col(f"a.{s}")) & (F.col(f"b.{at}") >= F.col(f"a.{s}") - within), "left")
    cols = [f"a.{c}" for c in spans.columns]
    return near.groupBy(*cols).agg(F.max_by(f"b.{value}", f"b.{at}").alias(value), F.max(f"b.{at}").alias(at))


def merge_ranges(df: DataFrame, key: str, s: str = "s", e: str = "e") -> DataFrame:
    """Maximal ranges covered by the ranges of each key."""
    before = W.partitionBy(key).orderBy(s, e)
    reach = F.max(e).over(before.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(s) > reach), 1).otherwise(0)
    grouped = df.select(key, s, e, new.alias("new")).withColumn("run", F.sum("new").over(before.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy(key, "run").agg(F.min(s).alias(s), F.max(e).alias(e)).drop("run")
