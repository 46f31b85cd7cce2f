"""What is done with findings: labels, corroboration, choices, queues, corrections, edits, gold, residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatia.functions.normalize import nfd
from verbatia.operators.tokens import word_arrays

def line_column(text: Column, at: Column) -> Column:
    """Line and column, from 1, of a code-point offset."""
    before = F.substring(text, F.lit(1), at)
    return F.struct((F.regexp_count(before, F.lit("\n")) + 1).cast("long").alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).cast("long").alias("column"))


def fold_map(text: Column) -> Column:
    """Folded characters with their places in the text: marks and soft hyphens are left out, letters lower-cased."""
    chars = F.split(text, "")
    placed = F.transform(chars, lambda x, i: F.struct(F.lower(x).alias("x"), i.alias("at")))
    return F.filter(placed, lambda p: ~p["x"].rlike("[\\p{M}­]") & (p["x"] != ""))


def letter_marks(word: Column) -> Column:
    """Letters of a word with the marks on each, as strings ``letter:marks``, by canonical decomposition."""
    units = F.regexp_extract_all(nfd(word), F.lit(r"\p{L}\p{M}*"), F.lit(0))
    return F.transform(units, lambda u: F.concat(F.substring(u, 1, 1), F.lit(":"), F.substring(u, 2, 99)))


#: Nunation that may stand on the letter before a final alef or on the alef.
NUNATION, FINAL_ALEF = "\u064b", "\u0627"


def mark_profile(word: Column) -> Column:
    """(letter, marks) of each letter of a word; nunation on a final alef counts for the letter before it."""
    word = F.regexp_replace(word, f"(\\p{{M}}*){FINAL_ALEF}{NUNATION}$", f"$1{NUNATION}{FINAL_ALEF}")
    return F.transform(letter_marks(word), lambda u: F.struct(F.substring(u, 1, 1).alias("letter"), F.array_distinct(F.filter(F.split(F.substring(u, 3, 99), ""), lambda m: m != "")).alias("marks")))


def marks_conflict(quote: Column, source: Column) -> Column:
    """Whether a word's profile has a mark that the source's has not at the same letter; marks left out are none. Words of other letters have no conflict."""
    same = F.transform(quote, lambda x: x["letter"]) == F.transform(source, lambda x: x["letter"])
    beyond = F.zip_with(quote, source, lambda a, b: F.size(F.array_except(a["marks"], b["marks"])) > 0)
    return same & F.exists(beyond, lambda x: x)


def marked_pairs(words: DataFrame, word: str = "fold") -> DataFrame:
    """(fold, other, conflict, other_conflict): distinct words with the same letters and other marks, and which has a mark that the other lacks there."""
    # Only words whose letters another word has too are told apart by their marks.
    bare = F.regexp_replace(nfd(F.col("fold")), r"[^\p{L}]+", "")
    rows = words.select(F.col(word).alias("fold")).filter("fold is not null").distinct().withColumn("bare", bare).filter("bare <> ''")
    rows = rows.withColumn("n", F.count("*").over(W.partitionBy("bare"))).filter("n > 1").select("fold", "bare", mark_profile(F.col("fold")).alias("p"))
    met = rows.alias("a").join(rows.select(F.col("fold").alias("other"), F.col("p").alias("q"), "bare"), "bare").filter("fold < other")
    return met.select("fold", "other", marks_conflict(F.col("p"), F.col("q")).alias("conflict"), marks_conflict(F.col("q"), F.col("p")).alias("other_conflict"))


def place_label(work: Column, unit0: Column, unit1: Column) -> Column:
    """Written place of one unit or a range of them."""
    return F.concat(work.cast("string"), F.lit(":"), unit0.cast("string"), F.when(unit1 > unit0, F.concat(F.lit("-"), unit1.cast("string"))).otherwise(""))


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def open_mark(text: Column, pairs: dict[str, str]) -> Column:
    """The innermost bracket or quotation mark still open at the end of a text, or an empty string.

    Marks are a stack: a closing mark takes away the opener at the top if they belong together, and is ignored otherwise.
    """
    every = "".join(pairs) + "".join(pairs.values())
    marks = F.split(F.regexp_replace(text, f"[^{every}]", ""), "")
    close = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair[::-1]])

    def step(stack: Column, mark: Column) -> Column:
        top = F.substring(stack, F.greatest(F.length(stack), F.lit(1)), F.lit(1))
        return F.when(F.length(mark) == 0, stack).when(close[mark].isNull(), F.concat(stack, mark)).when(close[mark] == top, F.substring(stack, F.lit(1), F.length(stack) - 1)).otherwise(stack)

    stack = F.aggregate(marks, F.lit(""), step)
    return F.substring(stack, F.greatest(F.length(stack), F.lit(1)), F.lit(1))


def locate(tokens: DataFrame, quotes: DataFrame, n: int, key: str = "quote_id") -> DataFrame:
    """(key, doc_id, d0, d1): every place where the n folded words of a quotation (array ``words``) stand in a row in a document."""
    line = W.partitionBy("doc_id").orderBy("tok").rowsBetween(0, n - 1)
    grams = tokens.select("doc_id", F.col("tok").alias("d0"), F.collect_list("fold").over(line).alias("words")).filter(F.size("words") == n)
    asked = quotes.filter(F.size("words") == n).select(key, "words")
    # Equal hashes are the join's key, equal words its condition.
    met = grams.withColumn("h", F.xxhash64("words")).alias("g").join(asked.withColumn("h", F.xxhash64("words")).alias("q"), (F.col("g.h") == F.col("q.h")) & (F.col("g.words") == F.col("q.words")))
    return met.select(f"q.{key}", "g.doc_id", "g.d0", (F.col("g.d0") + n).alias("d1"))


def text_locate(docs: DataFrame, quotes: DataFrame, n: int, key: str = "quote_id") -> DataFrame:
    """``locate`` in whole texts (doc_id, text), with the text's own ``words`` there; neighbours are met inside the rows, so that only places leave them."""
    grams = [f"g{i}" for i in range(n)]
    folds = word_arrays(docs, ["doc_id"]).select("doc_id", F.transform("raws", F.lower).alias("g0"))
    lines = folds.select("doc_id", F.posexplode(F.arrays_zip(F.col("g0"), *[F.slice("g0", F.lit(i + 1), F.size("g0")).alias(g) for i, g in enumerate(grams) if i])).alias("tok", "g"))
    said = lines.select("doc_id", F.col("tok").cast("long").alias("d0"), *[f"g.{g}" for g in grams])
    asked = quotes.filter(F.size("words") == n).select(key, *[F.get("words", F.lit(i)).alias(g) for i, g in enumerate(grams)])
    return said.join(asked, grams).select(key, "doc_id", "d0", (F.col("d0") + n).alias("d1"), F.array(*grams).alias("words"))


def wording_changes(runs: DataFrame, tokens: DataFrame, corpus_tokens: DataFrame, most: int = 2) -> DataFrame:
    """(doc_id, work, tok, pos, original, replacement): words between two runs of one diagonal that differ from the source.

    Two runs of a document that lie on one diagonal with at most ``most`` words between them are one quotation with
    those words replaced; the source's words are the correction.
    """
    line = W.partitionBy("doc_id", "work", F.col("d0") - F.col("b0")).orderBy("d0")
    after = runs.withColumn("next", F.lead("d0").over(line)).filter((F.col("next") > F.col("d1")) & (F.col("next") <= F.col("d1") + most))
    gaps = after.select("doc_id", "work", F.explode(F.sequence("d1", F.col("next") - 1)).alias("tok"), (F.col("d0") - F.col("b0")).alias("diag")).distinct()
    met = gaps.join(tokens.select("doc_id", "tok", F.col("raw").alias("original")), ["doc_id", "tok"]).withColumn("pos", F.col("tok") - F.col("diag"))
    return met.join(corpus_tokens.select("work", "pos", F.col("raw").alias("replacement")), ["work", "pos"]).select("doc_id", "work", "tok", "pos", "original", "replacement")


def shift_spans(spans: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans (s, e) after edits (s, e, added: characters more than before): moved by the edits ahead, stale if one touches them."""
    keys = [F.col(f"f.{c}") for c in spans.columns]
    met = spans.alias("f").join(edits.alias("x"), (F.col(f"f.{key}") == F.col(f"x.{key}")) & (F.col("x.s") < F.col("f.e")), "left")
    ahead = F.when(F.col("x.e") <= F.col("f.s"), F.col("x.added")).otherwise(0)
    out = met.groupBy(*keys).agg(F.sum(ahead).cast("long").alias("by"), (F.count_if(F.col("x.e") > F.col("f.s")) > 0).alias("stale"))
    return out.withColumn("s", F.col("s") + F.coalesce("by", F.lit(0))).withColumn("e", F.col("e") + F.coalesce("by", F.lit(0))).drop("by")


def match_gold(gold: DataFrame, found: DataFrame, key: str = "doc_id", share: float = 0.5) -> DataFrame:
    """Gold spans (g0, g1, gold_work) with the first finding (d0, d1, work) that covers at least a share of them, or null."""
    over = F.least("g1", "d1") - F.greatest("g0", "d0")
    met = gold.alias("g").join(found.alias("f"), (F.col(f"g.{key}") == F.col(f"f.{key}")) & (F.col("d0") < F.col("g1")) & (F.col("g0") < F.col("d1")) & (over >= share * (F.col("g1") - F.col("g0"))), "left")
    first = F.min(F.when(F.col("f.work").isNotNull(), F.struct("d0", "d1", "f.work")))
    out = met.groupBy(f"g.{key}", "g0", "g1", "gold_work").agg(first.alias("f"))
    return out.select(key, "g0", "g1", "gold_work", F.col("f.d0").alias("d0"), F.col("f.d1").alias("d1"), F.col("f.work").alias("work"))


def densest_runs(points: DataFrame, key: str, at: str, gap: int = 3) -> DataFrame:
    """(key, first, last, n): of the points cut where neighbours are more than ``gap`` apart, the longest run, the first among equals."""
    line = W.partitionBy(key).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(line) <= gap, 0).otherwise(1)
    runs = points.select(key, at, new.alias("new")).withColumn("run", F.sum("new").over(line)).groupBy(key, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    best = F.max_by(F.struct("first", "last", "n"), F.struct("n", -F.col("first")))
    return runs.groupBy(key).agg(best.alias("b")).select(key, "b.first", "b.last", "b.n")


def chunk_ends(corpus_tokens: DataFrame, ends: DataFrame, most: int = 5) -> DataFrame:
    """(work, pos, chunk_end): where a suggestion that begins at each word should stop: at the end of its unit, or after ``most`` words."""
    met = corpus_tokens.select("work", "pos", "unit").join(ends.select("work", "unit", "p1"), ["work", "unit"])
    return met.select("work", "pos", F.least(F.col("pos") + most, F.col("p1")).alias("chunk_end"))
