"""What the corpus says next: continuations of the last words of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatia.operators.corpus import Corpus


def suggest_next(tails: DataFrame, corpus: Corpus, key: str = "doc_id", words: int = 2, more: int = 3, limit: int = 4) -> DataFrame:
    """(key, work, p0, next, places, ambiguous): up to ``more`` words after the last ``words`` words, at most ``limit`` places.

    tails holds (key, tail): the folded last words. Places are counted before the limit.
    """
    line = W.partitionBy("work").orderBy("pos")
    grams = corpus.tokens.select("work", "pos", *[F.lead("fold", i).over(line).alias(f"w{i}") for i in range(words + more)])
    grams = grams.filter(f"w{words} is not null")
    grams = grams.select("work", F.col("pos").alias("p0"), F.array(*[f"w{i}" for i in range(words)]).alias("tail"), F.concat_ws(" ", *[f"w{words + i}" for i in range(more)]).alias("next"))
    met = tails.select(key, "tail").join(corpus.small(grams), "tail")
    rank = F.row_number().over(W.partitionBy(key).orderBy("work", "p0"))
    places = F.count("*").over(W.partitionBy(key))
    out = met.select(key, "work", "p0", "next", places.alias("places"), rank.alias("rank")).filter(F.col("rank") <= limit)
    return out.withColumn("ambiguous", F.col("places") > 1).drop("rank")
