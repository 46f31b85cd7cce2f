"""Suggestions at a caret, from a sorted suffix table of the corpus.

Every place of the corpus has a key: the words that end there, read backwards, each with an end mark. Sorted by key, the
places that continue a typed run longest are its neighbours, and the places of any number of its words are one range.
So a run of any length costs one search by merging, not one join for each length: typed runs are sorted among the places,
their neighbours give the number of words matched, and the ends of the range of those words are sorted among the places again.

The sort is by ranges of (key, work, pos), so that neither a frequent last word nor a passage that the corpus
repeats falls into one task; what crosses the ranges (counts, first and last key) is one row a range.

Cases: a run without words, or of which fewer than two words match, has no place. Repeated runs are looked up once. A null
opening mark or trigger word opens nothing. An empty corpus gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatia.operators.corpus import Corpus
from verbatia.sources.tables import written

END, AFTER = "\x01", "\x02"


@dataclass(frozen=True)
class Gates:
    """Bars of a suggestion; places and mass by the number of matched words, the last bar for all longer ones."""

    run_words: int = 40
    places: tuple = ((2, 6), (3, 12), (None, 16))
    mass: tuple = ((2, 7.0), (3, 9.0), (None, 9.0))
    distinct_words: int = 4
    distinct_mass: float = 12.0
    correction_words: int = 3
    correction_mass: float = 12.0
    correction_places: int = 2
    dominates: int = 2
    opener_gap: int = 1
    skipped: int = 2
    chunk: int = 4
    tail: int = 5
    choices: int = 4


def backwards(words: Column) -> Column:
    """The key of a run of words that ends at a place."""
    return F.concat_ws("", F.transform(F.reverse(words), lambda w: F.concat(w, F.lit(END))))


def _words(key: Column) -> Column:
    parts = F.split(F.coalesce(key, F.lit("")), END)
    return F.slice(parts, 1, F.size(parts) - 1)


def _common(a: Column, b: Column) -> Column:
    """How many words two keys share from their start."""
    same = F.zip_with(_words(a), _words(b), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False)
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")


def suffix_table(corpus: Corpus, width: int = Gates.run_words) -> DataFrame:
    """(key, work, pos): every place of the corpus with the at most ``width`` words of its work that end there."""
    line = W.partitionBy("work").orderBy("pos")
    return corpus.tokens.select(backwards(F.collect_list("fold").over(line.rowsBetween(1 - width, 0))).alias("key"), "work", "pos")


def ranked(places: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys sorted among the places: (key, below, prev, next), the places before each and the keys of its neighbours; and (number, work, pos)."""
    order = ["key", "place", "work", "pos"]
    none = {f.name: F.lit(None).cast(f.dataType) for f in places.schema.fields if f.name != "key"}
    rows = places.withColumn("place", F.lit(1)).unionByName(keys.select("key").distinct().withColumns(none | {"place": F.lit(0)}))
    laid = written(rows.orderBy(*order).withColumn("part", F.spark_partition_id()))
    here = F.when(F.col("place") == 1, F.col("key"))
    earlier = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy("part").orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, -1)
    inside = laid.withColumns({"n": F.coalesce(F.sum("place").over(earlier), F.lit(0)), "prev": F.last(here, True).over(earlier), "next": F.last(here, True).over(later)})
    parts = laid.groupBy("part").agg(F.sum("place").alias("m"), F.min(here).alias("low"), F.max(here).alias("high"))
    up, down = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("m").over(up), F.lit(0)).alias("before"), F.last("high", True).over(up).alias("last"), F.last("low", True).over(down).alias("first"))
    out = inside.join(F.broadcast(parts), "part").withColumn("below", F.col("n") + F.col("before"))
    found = out.filter("place = 0").select("key", "below", F.coalesce("prev", "last").alias("prev"), F.coalesce("next", "first").alias("next"))
    return found, out.filter("place = 1").select(F.col("below").alias("number"), "work", "pos")


def longest_matches(runs: DataFrame, corpus: Corpus, gates: Gates = Gates()) -> tuple[DataFrame, DataFrame]:
    """(run, matched, lo, hi, mass) of every distinct key ``run`` of which two words or more end somewhere in the corpus; and (number, work, pos).

    ``matched`` is the most of its last words that stand together in one work; they end at the places numbered lo to hi - 1.
    """
    places = suffix_table(corpus, gates.run_words)
    near, _ = ranked(places, runs.select(F.col("run").alias("key")).filter("key <> ''"))
    matched = F.greatest(_common(F.col("key"), F.col("prev")), _common(F.col("key"), F.col("next")))
    near = near.select(F.col("key").alias("run"), matched.alias("matched")).filter("matched >= 2")
    low = F.concat_ws("", F.transform(F.slice(_words(F.col("run")), F.lit(1), F.col("matched")), lambda w: F.concat(w, F.lit(END))))
    near = written(near.withColumn("low", low).withColumn("high", F.concat(F.expr("substring(low, 1, length(low) - 1)"), F.lit(AFTER))))
    ends, numbers = ranked(places, near.select(F.col("low").alias("key")).union(near.select("high")))
    ends = written(ends.select("key", "below"))
    said = near.select("low").distinct().select("low", F.explode(_words(F.col("low"))).alias("fold"))
    mass = said.join(corpus.small(corpus.vocab.select("fold", "idf")), "fold").groupBy("low").agg(F.round(F.sum("idf"), 6).alias("mass"))
    out = near.join(ends.select(F.col("key").alias("low"), F.col("below").alias("lo")), "low")
    out = out.join(ends.select(F.col("key").alias("high"), F.col("below").alias("hi")), "high").join(mass, "low")
    return out.select("run", "matched", "lo", "hi", "mass"), numbers


def _bar(bars: tuple, matched: Column) -> Column:
    out = F.lit(bars[-1][1])
    return reduce(lambda rest, bar: F.when(matched == bar[0], bar[1]).otherwise(rest), reversed(bars[:-1]), out)


def _trigger(words: Column, since: Column, matched: Column, cues: list[str], distinct: bool, gates: Gates) -> Column:
    """Why words that end ``since`` words behind an open mark may be continued, if ``matched`` of them count from the end."""
    gap, ahead = since - matched, F.size(words) - matched
    out = F.when(gap.between(0, gates.opener_gap), "opener")
    out = out.when((ahead > 0) & F.get(words, ahead - 1).isin(*cues), "cue") if cues else out
    return out.otherwise(F.lit("distinct" if distinct else None))


def judged(carets: DataFrame, corpus: Corpus, cues: list[str] = (), distinct: bool = True, gates: Gates = Gates()) -> tuple[DataFrame, DataFrame]:
    """Every caret with what its words match, its trigger, and what blocks a continuation or a correction; and the numbered places.

    carets holds any columns with ``words``, the folded words directly before the caret, and ``since``, how many of them follow the
    innermost open mark (null without one). The whole run and the run without its last word are looked up; a run without its last word that matches
    ``dominates`` words more than the whole run does is held to be what is quoted, and its last word to be the odd one.
    """
    full = F.slice("words", F.greatest(F.size("words") - gates.run_words + 1, F.lit(1)), gates.run_words)
    every = carets.withColumn("words", full)
    # Only words of which the last two, or the two before the last, stand together in the corpus match anything: the others are neither written, sorted nor joined.
    pairs = written(corpus.pairs.select("fold", "next_fold").distinct())
    n, none = F.size("words"), {"matched": "int", "lo": "long", "hi": "long", "mass": "double"}
    for side, back in (("", 1), ("1", 2)):
        known = pairs.select(F.col("fold").alias("_a"), F.col("next_fold").alias("_b"), F.lit(True).alias(f"_met{side}"))
        every = every.withColumns({"_a": F.get("words", n - back - 1), "_b": F.get("words", n - back)}).join(corpus.small(known), ["_a", "_b"], "left").drop("_a", "_b")
    may = F.coalesce("_met", "_met1", F.lit(False))
    rest = every.filter(~may).drop("_met", "_met1").withColumns({f"{c}{side}": F.lit(None).cast(kind) for side in ("", "1") for c, kind in none.items()})
    rest = rest.withColumns({"matched": F.lit(0), "matched1": F.lit(0), "wins": F.lit(False)})
    rows = every.filter(may).drop("_met", "_met1").withColumn("run", backwards(F.col("words")))
    rows = written(rows.withColumn("run1", backwards(F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))))))
    met, numbers = longest_matches(rows.select("run").union(rows.select("run1")), corpus, gates)
    met = written(met)
    name = {"matched": "matched1", "lo": "lo1", "hi": "hi1", "mass": "mass1"}
    rows = rows.join(met, "run", "left").join(met.withColumnsRenamed(name | {"run": "run1"}), "run1", "left").drop("run", "run1").fillna(0, ["matched", "matched1"])
    wins = (F.col("matched1") >= gates.correction_words) & (F.col("matched1") >= F.col("matched") + gates.dominates)
    triggers = {"trigger": _trigger(F.col("words"), F.col("since"), F.col("matched"), cues, distinct, gates)}
    triggers["trigger1"] = _trigger(F.slice("words", F.lit(1), F.size("words") - 1), F.col("since") - 1, F.col("matched1"), cues, distinct, gates)
    rows = rows.withColumn("wins", wins).withColumns(triggers)
    rest = rest.withColumns(triggers | {"blocked": F.lit("no_match"), "mends": F.lit(False)})
    places, plain = F.col("hi") - F.col("lo"), F.col("trigger") == "distinct"
    blocked = F.when((F.col("matched") < 2) | F.col("wins"), "no_match").when(F.col("trigger").isNull(), "no_trigger")
    blocked = blocked.when(plain & (F.col("matched") < gates.distinct_words), "too_short")
    blocked = blocked.when(F.col("mass") < F.when(plain, gates.distinct_mass).otherwise(_bar(gates.mass, F.col("matched"))), "too_common")
    blocked = blocked.when(places > _bar(gates.places, F.col("matched")), "ambiguous")
    mends = (F.col("matched1") >= gates.correction_words) & ((F.col("matched") < 3) | F.col("wins")) & F.col("trigger1").isNotNull()
    mends = mends & (F.col("mass1") >= gates.correction_mass) & (F.col("hi1") - F.col("lo1") <= gates.correction_places)
    return rows.withColumn("blocked", blocked).withColumn("mends", F.coalesce(mends, F.lit(False))).unionByName(rest), numbers


def suggest(carets: DataFrame, keys: list[str], corpus: Corpus, cues: list[str] = (), distinct: bool = True, gates: Gates = Gates()) -> DataFrame:
    """(keys, kind, typed, work, unit, to_text, rank, places, ambiguous): at most ``choices`` suggestions a caret, best first.

    ``continue`` gives the next words of the unit; ``insert`` the words left out before the last one, if that stands a little further on
    in the unit; ``replace`` the word in place of it. Of the places in one unit the first counts. ``ambiguous`` tells that the choices differ in text or unit.
    """
    rows, numbers = judged(carets, corpus, cues, distinct, gates)
    rows = written(rows.select(*keys, F.element_at("words", -1).alias("odd"), "matched", "matched1", "lo", "hi", "lo1", "hi1", "blocked", "mends").filter("blocked is null or mends"))
    on = F.when(F.col("blocked").isNull(), F.struct(F.lit(0).alias("mend"), F.col("matched").alias("typed"), "lo", "hi"))
    mend = F.when(F.col("mends"), F.struct(F.lit(1).alias("mend"), F.col("matched1").alias("typed"), F.col("lo1").alias("lo"), F.col("hi1").alias("hi")))
    asked = rows.select(*keys, "odd", F.explode(F.array_compact(F.array(on, mend))).alias("a")).select(*keys, "odd", "a.mend", "a.typed", (F.col("a.hi") - F.col("a.lo")).alias("places"), F.explode(F.sequence("a.lo", F.col("a.hi") - 1)).alias("number"))
    ahead = W.partitionBy("work", "unit").orderBy("pos").rowsBetween(1, max(gates.tail, gates.skipped) + 1)
    following = corpus.tokens.select("work", "pos", "unit", F.collect_list(F.struct("raw", "fold")).over(ahead).alias("ahead"))
    at = asked.join(numbers, "number").join(corpus.small(following), ["work", "pos"]).filter("size(ahead) > 0")
    raws, folds = F.col("ahead.raw"), F.col("ahead.fold")
    chunk = F.slice(raws, F.lit(1), F.when(F.size(raws) <= gates.tail, F.size(raws)).otherwise(gates.chunk))
    left_out = F.array_position(F.slice(folds, 2, gates.skipped), F.col("odd")).cast("int")
    kind = F.when(F.col("mend") == 0, "continue").when(left_out > 0, "insert").otherwise("replace")
    text = F.when(F.col("mend") == 0, chunk).otherwise(F.slice(raws, F.lit(1), F.greatest(left_out, F.lit(1))))
    at = at.filter((F.col("mend") == 0) | (folds[0] != F.col("odd"))).withColumns({"kind": kind, "to_text": F.array_join(text, " ")})
    order = F.when(F.col("kind") == "continue", 0).when(F.col("kind") == "insert", 1).otherwise(2)
    one = at.groupBy(*keys, "kind", "typed", "places", "work", "unit").agg(F.min_by("to_text", "pos").alias("to_text"))
    kept = one.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(order, F.desc("typed"), "work", "unit"))).filter(F.col("rank") <= gates.choices)
    caret = W.partitionBy(*keys)
    texts, units = F.size(F.collect_set(F.lower("to_text")).over(caret)), F.size(F.collect_set(F.struct("work", "unit")).over(caret))
    return kept.withColumns({"places": F.greatest(F.max("places").over(caret), units), "ambiguous": (texts > 1) | (units > 1)})
