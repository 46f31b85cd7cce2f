"""Written citations by the name of a work, and which citation belongs to which quotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatia.functions.normalize import GENERIC, Profile, ascii_digits
from verbatia.operators.extract import pattern_spans
from verbatia.operators.intervals import block, blocked

#: A name of one or two words, an optional word or punctuation between, one or two numbers.
NAMED = r"[\p{L}\p{M}]+(?: [\p{L}\p{M}]+)?[\s,:،]{1,3}(?:[\p{L}\p{M}]+[\s:]{1,2})?[0-9٠-٩۰-۹]{1,3}(?:\s?[-–—]\s?[0-9٠-٩۰-۹]{1,3})?"


def named_references(docs: DataFrame, works: DataFrame, key: str = "doc_id", text: str = "text", profile: Profile = GENERIC) -> DataFrame:
    """(key, s, e, found, work, unit0, unit1, problem): citations whose name is in works(work, name, n_units).

    A name of two words is tried before its second word alone. Numbers beyond the work's units and reversed
    ranges are kept, with what is wrong.
    """
    refs = pattern_spans(docs, key, text, NAMED)
    words = F.regexp_extract_all("folded", F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
    numbers = F.transform(F.regexp_extract_all(ascii_digits(F.col("found")), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    refs = refs.withColumn("folded", profile.folded(F.col("found"))).select(key, "s", "e", "found", words.alias("w"), numbers.alias("n"))
    tried = F.array_distinct(F.filter(F.array(F.concat_ws(" ", F.slice("w", 1, 2)), F.get("w", F.lit(0)), F.get("w", F.lit(1))), lambda x: x.isNotNull()))
    named = works.select("work", profile.folded(F.col("name")).alias("name"), "n_units")
    met = refs.select("*", F.posexplode(tried).alias("turn", "name")).join(F.broadcast(named) if named.count() <= 100_000 else named, "name")
    best = F.row_number().over(W.partitionBy(key, "s").orderBy("turn", "work"))
    met = met.withColumn("best", best).filter("best = 1")
    last = F.coalesce(F.get("n", F.lit(1)), F.col("n")[0])
    problem = F.when(last < F.col("n")[0], "reversed").when((F.col("n")[0] < 1) | (last > F.col("n_units")), "out_of_range").otherwise("none")
    return met.select(key, "s", "e", "found", "work", F.col("n")[0].alias("unit0"), last.alias("unit1"), problem.alias("problem"))


def hinted_references(spans: DataFrame, refs: DataFrame, key: str = "doc_id", within: int = 150, profile: Profile = GENERIC) -> DataFrame:
    """(key, s, e, ref_s, ref_e): spans with a ``hint`` of their citation's words, and the citation that bears it out.

    A citation (s, e, found) starts at most ``within`` characters from the span's end, and its words hold the hint's or are held by
    them, folded. Spans choose in order, each the first citation that no span before it has. Places meet by blocks of that length, so
    that only neighbours are compared.
    """
    fold = lambda c: F.trim(F.regexp_replace(profile.folded(c), r"\s+", " "))
    asked = spans.select(key, "s", "e", fold(F.col("hint")).alias("_hint"), F.floor(F.col("e") / within).alias("_block")).filter("_hint <> ''")
    near = F.explode(F.array(*(F.floor(F.col("s") / within) + d for d in (-1, 0, 1)))).alias("_block")
    said = refs.select(key, F.col("s").alias("ref_s"), F.col("e").alias("ref_e"), fold(F.col("found")).alias("_found"), near).filter("_found <> ''")
    met = asked.join(said, [key, "_block"]).filter((F.abs(F.col("ref_s") - F.col("e")) <= within) & (F.col("_found").contains(F.col("_hint")) | F.col("_hint").contains(F.col("_found"))))
    # Of a document's few agreeing pairs each is taken, in order, if its span and its citation are still free.
    pairs = met.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("s", "e", "ref_s", "ref_e"))).alias("pairs"))
    free = lambda acc, x: ~F.exists(acc, lambda k: ((k["s"] == x["s"]) & (k["e"] == x["e"])) | ((k["ref_s"] == x["ref_s"]) & (k["ref_e"] == x["ref_e"])))
    taken = F.aggregate("pairs", F.filter("pairs", lambda x: F.lit(False)), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return pairs.select(key, F.inline(taken))


def attach_references(spans: DataFrame, refs: DataFrame, key: str = "doc_id", after: int = 40, before: int = 60, profile: Profile = GENERIC) -> DataFrame:
    """spans(key, s, e, ...) with the citation that belongs to each: columns ref_s and ref_e, null if none.

    First the nearest citation behind a span and before the next span; then, if spans have a column ``hint``, a free citation that bears the
    hint out; then, for spans without one, the nearest unused citation ahead of it and behind the span before. A citation serves one span, the nearer.
    """
    line = W.partitionBy(key).orderBy("s", "e")
    bounded = spans.withColumn("_next", F.lead("s").over(line)).withColumn("_last", F.lag("e").over(line))
    points = refs.select(key, F.col("s").alias("ref_s"), F.col("e").alias("ref_e"))

    def nearest(a: DataFrame, edge: str, point: str, within: int, side: int, cond, gap) -> DataFrame:
        near = points.withColumn("_block", block(F.col(point), within))
        met = blocked(a, F.col(edge), within, side).join(near, [key, "_block"]).drop("_block").filter(cond).withColumn("_gap", gap)
        mine = F.row_number().over(W.partitionBy(key, "s", "e").orderBy("_gap", "ref_s"))
        theirs = F.row_number().over(W.partitionBy(key, "ref_s").orderBy("_gap", "s"))
        return met.withColumn("_mine", mine).filter("_mine = 1").withColumn("_theirs", theirs).filter("_theirs = 1").select(key, "s", "e", "ref_s", "ref_e")

    ahead = nearest(bounded, "e", "ref_s", after, 1, (F.col("ref_s") >= F.col("e")) & (F.col("ref_s") <= F.col("e") + after) & (F.col("_next").isNull() | (F.col("ref_s") < F.col("_next"))), F.col("ref_s") - F.col("e"))
    left = bounded.join(ahead, [key, "s", "e"], "left_anti")
    if "hint" in spans.columns:
        unused = refs.join(ahead.select(key, F.col("ref_s").alias("s"), F.col("ref_e").alias("e")), [key, "s", "e"], "left_anti")
        ahead = ahead.unionByName(hinted_references(left, unused, key, profile=profile))
        left = bounded.join(ahead, [key, "s", "e"], "left_anti")
    free = (F.col("ref_e") <= F.col("s")) & (F.col("ref_e") >= F.col("s") - before) & (F.col("_last").isNull() | (F.col("ref_s") >= F.col("_last")))
    behind = nearest(left, "s", "ref_e", before, -1, free, F.col("s") - F.col("ref_e")).join(ahead.select(key, "ref_s"), [key, "ref_s"], "left_anti")
    return spans.join(ahead.unionByName(behind), [key, "s", "e"], "left")
