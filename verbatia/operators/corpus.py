"""A canonical corpus as tables: units, tokens, vocabulary, unit bounds, word pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatia.functions.normalize import GENERIC, Profile
from verbatia.operators.tokens import tokenize_with_gaps

#: Corpus tokens that may be broadcast; larger corpora are joined by shuffle.
BROADCAST_TOKENS = 2_000_000


@dataclass
class Corpus:
    """tokens(work, pos, unit, raw, fold), vocab(fold, df, idf), bounds(work, unit, p0, p1), pairs(fold, next_fold, work, pos, unit)."""

    tokens: DataFrame
    vocab: DataFrame
    bounds: DataFrame
    units: int

    @property
    def pairs(self) -> DataFrame:
        following = F.lead("fold").over(W.partitionBy("work").orderBy("pos"))
        return self.tokens.select("fold", following.alias("next_fold"), "work", "pos", "unit").filter("next_fold is not null")

    def small(self, df: DataFrame) -> DataFrame:
        """A broadcast of ``df``, a part of the corpus, if the corpus is within the bound."""
        return F.broadcast(df) if self.size <= BROADCAST_TOKENS else df

    @property
    def size(self) -> int:
        if not hasattr(self, "_size"):
            self._size = self.tokens.count()
        return self._size


def build_corpus(works: DataFrame, work: str = "item_id", text: str = "text", profile: Profile = GENERIC, unit_end: str = r"[.!?\n]") -> Corpus:
    """Tokens numbered within each work; a unit ends where the text between two tokens has an end mark."""
    rows = works.select(F.col(work).alias("work"), F.col(text).alias("text"))
    tokens = tokenize_with_gaps(rows, ["work"], profile=profile)
    ends = F.when((F.col("tok") > 0) & F.col("gap").rlike(unit_end), 1).otherwise(0)
    tokens = tokens.withColumn("unit", F.sum(ends).over(W.partitionBy("work").orderBy("tok")))
    tokens = tokens.select("work", F.col("tok").alias("pos"), "unit", "raw", "fold")
    bounds = tokens.groupBy("work", "unit").agg(F.min("pos").alias("p0"), (F.max("pos") + 1).alias("p1"))
    units = bounds.count()
    df = tokens.select("fold", "work", "unit").distinct().groupBy("fold").agg(F.count("*").alias("df"))
    vocab = df.withColumn("idf", F.log(F.lit(float(max(1, units))) / F.col("df")))
    return Corpus(tokens, vocab, bounds, units)
