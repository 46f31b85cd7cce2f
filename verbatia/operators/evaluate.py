"""Scoring: pooled rates over grouping sets, run comparison, error rates of recognised text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rate(num: Column, den: Column) -> Column:
    """num / den to six places; null without a denominator."""
    return F.when(den != 0, F.round(num / den, 6))


def compare_runs(before: DataFrame, after: DataFrame, on: list[str], value: str) -> DataFrame:
    """Full outer comparison of two runs: same, changed, gained or lost."""
    a, b = before.select(*on, F.col(value).alias("before")), after.select(*on, F.col(value).alias("after"))
    status = F.when(F.col("before").isNull(), "gained").when(F.col("after").isNull(), "lost").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return a.join(b, on, "full_outer").withColumn("status", status)


def nearest_rank(df: DataFrame, key: str, value: str, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """(key, p50, p95, ...): the value at index round(p / 100 * n + 0.5) - 1 of each key's ascending values."""
    order = W.partitionBy(key).orderBy(value)
    ranked = df.select(key, value, F.row_number().over(order).alias("r"), F.count("*").over(W.partitionBy(key)).alias("n"))
    at = lambda p: F.greatest(F.lit(1), F.least(F.col("n"), F.bround(F.lit(p) / 100 * F.col("n") + 0.5, 0).cast("long")))
    return ranked.groupBy(key).agg(*[F.max(F.when(F.col("r") == at(p), F.col(value))).alias(f"p{p}") for p in percents])


def distance_columns(truth: list[str], text: list[str]) -> list[tuple[int, int]]:
    """For each word of ``text``, bit vectors over the words of ``truth``: where the distance grows downwards, and where it is that of the field diagonally before.

    Neighbouring fields of the distance table differ by one at most, so a whole column is a few operations on integers
    with one bit a word (Myers, in the form of Hyyro).
    """
    every, where = (1 << len(truth)) - 1, {}
    for i, word in enumerate(truth):
        where[word] = where.get(word, 0) | 1 << i
    grows, shrinks, out = every, 0, []
    for word in text:
        same = where.get(word, 0)
        level = (((same & grows) + grows) ^ grows) | same | shrinks
        # Steps to the right, moved one word down: the row above all words grows with every column.
        right, left = (shrinks | ~(level | grows)) << 1 | 1, (grows & level) << 1
        grows, shrinks = (left | ~(level | right)) & every, right & level & every
        out.append((grows, level))
    return out


def edit_counts(truth: list[str], text: list[str]) -> tuple[int, int, int, int]:
    """(equal, substituted, deleted, inserted) of a least edit script; from the end a diagonal step is preferred, then a deletion."""
    columns, counts, i, j = distance_columns(truth, text), [0, 0, 0, 0], len(truth), len(text)
    while i and j:
        (grows, level), same = columns[j - 1], truth[i - 1] == text[j - 1]
        if same or not level >> (i - 1) & 1:
            kind = 0 if same else 1
        else:
            kind = 2 if grows >> (i - 1) & 1 else 3
        counts[kind] += 1
        i, j = i - (kind != 3), j - (kind != 2)
    counts[2] += i
    counts[3] += j
    return tuple(counts)


def word_errors(pairs: DataFrame, truth: str, text: str) -> DataFrame:
    """All columns, and a struct ``words`` of equal, substituted, deleted and inserted words; a null text misses every word."""

    def count(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([edit_counts((x or "").split(), (y or "").split()) for x, y in zip(a, b)], columns=["equal", "substituted", "deleted", "inserted"])

    return pairs.withColumn("words", F.pandas_udf(count, "equal int, substituted int, deleted int, inserted int")(F.col(truth), F.col(text)))
