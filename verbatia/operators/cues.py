"""Words that announce a quotation, the windows behind them, and the source passages those windows hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatia.operators.tokens import with_ends, word_arrays

BLOCK = 64


def cue_windows(tokens: DataFrame, cues: dict[str, str], most: int = 40, least: int = 2, stop: str = r"[.!?\n]") -> DataFrame:
    """(doc_id, w0, w1, kind): windows of words behind cue words (word: kind), up to the end of the sentence and ``most`` words.

    tokens have the gap before each word. Of windows with the same end the one with the nearest cue stays, since its window
    lies inside the others; kinds are compared in alphabetical order where one word gives several.
    """
    back = W.partitionBy("doc_id").orderBy(F.desc("tok"))
    ends = F.last(F.when(F.col("gap").rlike(stop), F.col("tok")), True).over(back.rowsBetween(W.unboundedPreceding, -1))
    last = F.max("tok").over(W.partitionBy("doc_id"))
    named = tokens.sparkSession.createDataFrame([*cues.items()], "fold string, kind string")
    placed = tokens.select("doc_id", "tok", "fold", F.coalesce(ends, last + 1).alias("stop"))
    met = placed.join(F.broadcast(named), "fold").select("doc_id", (F.col("tok") + 1).alias("w0"), F.least("stop", F.col("tok") + 1 + most).alias("w1"), "kind")
    return _nearest(met, least)


def _nearest(met: DataFrame, least: int) -> DataFrame:
    near = F.row_number().over(W.partitionBy("doc_id", "w1").orderBy(F.desc("w0"), "kind"))
    return met.filter(F.col("w1") - F.col("w0") >= least).withColumn("n", near).filter("n = 1").drop("n")


def text_windows(docs: DataFrame, cues: dict[str, str], most: int = 40, least: int = 2, stop: str = r"[.!?\n]") -> DataFrame:
    """``cue_windows`` of whole texts (doc_id, text), with their code-point offsets s and e; made within the rows, so that only windows are shuffled."""
    rows = with_ends(word_arrays(docs, ["doc_id"])).withColumn("stops", F.transform("gaps", lambda g: g.rlike(stop)))
    named = docs.sparkSession.createDataFrame([*cues.items()], "fold string, kind string")
    each = rows.select("doc_id", "raws", "ends", "stops", F.posexplode("raws").alias("tok", "raw"))
    met = each.withColumn("fold", F.lower("raw")).join(F.broadcast(named), "fold")
    cut = F.array_position(F.slice("stops", F.col("tok") + 2, F.lit(most)), True)
    w1 = F.when(cut > 0, F.col("tok") + cut).otherwise(F.least(F.size("raws"), F.col("tok") + 1 + most)).cast("int")
    met = met.select("doc_id", "raws", "ends", (F.col("tok") + 1).alias("w0"), w1.alias("w1"), "kind").filter(F.col("w1") - F.col("w0") >= least)
    start = F.get("ends", F.col("w0")) - F.length(F.get("raws", F.col("w0")))
    return _nearest(met.select("doc_id", F.col("w0").cast("long").alias("w0"), F.col("w1").cast("long").alias("w1"), "kind", start.alias("s"), F.get("ends", F.col("w1") - 1).alias("e")), least)


def cue_hits(windows: DataFrame, shared: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, w0, w1, kind, work, diag, matched, mass): the best diagonal of each window by the rare words it shares with a work.

    shared(doc_id, tok, work, diag, idf) are rare words of documents that also stand in works. More words win, then the
    rarer ones, then the first work and diagonal. Windows and words meet by blocks of ``BLOCK`` words of the document.
    """
    blocks = F.explode(F.sequence(F.floor(F.col("w0") / BLOCK), F.floor((F.col("w1") - 1) / BLOCK)))
    laid = windows.filter("w0 < w1").withColumn("block", blocks)
    met = laid.join(shared.withColumn("block", F.floor(F.col("tok") / BLOCK)), ["doc_id", "block"]).filter((F.col("tok") >= F.col("w0")) & (F.col("tok") < F.col("w1")))
    votes = met.groupBy("doc_id", "w0", "w1", "kind", "work", "diag").agg(F.count("*").alias("matched"), F.round(F.sum("idf"), 6).alias("mass"))
    rank = F.row_number().over(W.partitionBy("doc_id", "w0", "w1").orderBy(F.desc("matched"), F.desc("mass"), "work", "diag"))
    return votes.filter(F.col("matched") >= least).withColumn("n", rank).filter("n = 1").drop("n")


def relation(s: str, e: str, s2: str, e2: str):
    """How the range (s, e) lies to the range (s2, e2)."""
    a, b, c, d = (F.col(x) for x in (s, e, s2, e2))
    return F.when((a == c) & (b == d), "same").when((a >= c) & (b <= d), "narrower").when((a <= c) & (b >= d), "wider").otherwise("shifted")
