"""Spelling variants: words that differ by one code point, the commonest of them as a word's form, and roots.

Two words differ by one inserted, deleted or replaced code point only if one half of the first stands unchanged in the
second, at its start or at its end. So a word of n code points looks for its first n // 2 among the beginnings of words of
n - 1 to n + 1, and for the rest among their ends. Words are dealt out by (direction, n, half); every task builds a minimal acyclic
automaton over its words, forward or of reversed words, whose edges carry how many words stand before them: a path to an accepting
state sums up to the word's number (a perfect hash), which finds the word and its count in arrays. A search walks its half exactly
and then allows one error. A pair that both directions hold is reported by the forward one.

Halves that more than ``GROUP_WORDS`` words share are dealt out once more by the halves of what follows the half: the one error
leaves one of these unchanged too. Counting is a partial aggregation, and forms and roots are joins over the table of words;
a chain of forms grows five times at every step, so pointers are doubled a few times at most.

Cases: null and empty texts have no words; null ids count as the empty id. Repeated rows count again. Only the named columns
are read. Texts of any length pass whole. Words without a near word are their own root. Empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatia.llm.work import BROADCAST_IDS, Workspace, give_back

LETTERS = "A-Za-zÀ-ÿ"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of one half before what follows the half is used too.
GROUP_WORDS = 20_000
#: What a key of a word stands for: its half, or the half and the first or the last part of what follows.
ALL, FIRST, LAST = 0, 1, 2


class Automaton:
    """The minimal acyclic automaton of distinct words given in ascending order, with word numbers.

    ``edges[s]`` maps a character to (next state, words of s that come before those behind the edge).
    """

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.accepts: list[bool] = []
        self.size: list[int] = []
        self.states: dict[tuple, int] = {}
        # The last word's path is open: characters and the edges found so far behind each of them.
        path: list[tuple[bool, list[tuple[str, int]]]] = [(False, [])]
        before = ""
        for word in words:
            same = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                same += 1
            self._close(path, before, same)
            path += [(False, []) for _ in range(len(word) - same)]
            path[-1] = (True, path[-1][1])
            before = word
        self._close(path, before, 0)
        self.root = self._state(*path[0])

    def _close(self, path: list, word: str, keep: int) -> None:
        while len(path) > keep + 1:
            state = self._state(*path.pop())
            path[-1][1].append((word[len(path) - 1], state))

    def _state(self, accepts: bool, edges: list[tuple[str, int]]) -> int:
        """The one state with this acceptance and these edges."""
        key = (accepts, *edges)
        if (known := self.states.get(key)) is None:
            known = self.states[key] = len(self.edges)
            total, own = int(accepts), {}
            for x, s in edges:
                own[x] = (s, total)
                total += self.size[s]
            self.edges.append(own)
            self.accepts.append(accepts)
            self.size.append(total)
        return known

    def walk(self, state: int, number: int, rest: str) -> tuple[int, int] | None:
        edges = self.edges
        for x in rest:
            if (step := edges[state].get(x)) is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def number(self, word: str) -> int | None:
        """The place of a word among the words, or none."""
        found = self.walk(self.root, 0, word)
        return found[1] if found and self.accepts[found[0]] else None

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with the first ``exact`` characters and differ from the word by one character behind them."""
        out: set[int] = set()
        found = self.walk(self.root, 0, word[:exact])
        walk, edges, accepts = self.walk, self.edges, self.accepts

        def end(state: int, number: int, rest: str) -> None:
            if (got := walk(state, number, rest)) and accepts[got[0]]:
                out.add(got[1])

        for i in range(exact, len(word) + 1):
            if found is None:
                break
            state, number = found
            own = word[i] if i < len(word) else None
            if own is not None:
                end(state, number, word[i + 1 :])
            for x, (then, skip) in edges[state].items():
                end(then, number + skip, word[i:])
                if own is not None and x != own:
                    end(then, number + skip, word[i + 1 :])
            found = walk(state, number, own) if own is not None else None
        return out


def runs(docs: DataFrame, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, run): maximal runs of ``least`` letters or more, only A-Z lower-cased; one row an occurrence."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.explode(found).alias("run"))
    return rows.withColumn("run", F.translate("run", CAPITALS, SMALL))


def misread(run: Column, doc_id: Column, every: int = 199) -> Column:
    """The run with one code point left out, if ``every`` divides the checksum h of the document and the run: that at h modulo its length."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(rows: DataFrame, least: int = 6, often: int = 5, word: str = "word") -> DataFrame:
    """(word, n): words of ``least`` code points that occur ``often`` times, at least."""
    return rows.filter(F.length(word) >= least).groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= often)


def _dealt(words: DataFrame, ws: Workspace) -> DataFrame:
    """(word, n, back, exact, asks, part, key): each word with the halves under which it looks for others or is found by them."""
    size = F.length("word")
    cases = F.array(*(F.struct(F.lit(b).alias("back"), (size + d).alias("m"), F.lit(d == 0).alias("asks")) for b in (False, True) for d in (-1, 0, 1)))
    rows = words.select("word", "n", F.explode(cases).alias("c")).select("word", "n", "c.*")
    rows = rows.withColumn("half", F.floor(F.col("m") / 2).cast("int"))
    rows = rows.withColumn("exact", F.when(F.col("back"), F.col("m") - F.col("half")).otherwise(F.col("half")))
    rows = rows.withColumn("read", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))).filter((F.col("m") > 0) & (size >= F.col("exact")))
    rows = rows.withColumn("key", F.concat_ws(" ", F.col("back").cast("int").cast("string"), F.col("m").cast("string"), F.substring("read", F.lit(1), F.col("exact"))))
    rows = ws.save(rows.select("word", "n", "back", "m", "exact", "asks", "read", "key"), "halves")
    large = ws.save(rows.groupBy("key").count().filter(F.col("count") > GROUP_WORDS).select("key", F.lit(True).alias("large")), "large")
    rows = rows.join(F.broadcast(large) if large.count() <= BROADCAST_IDS else large, "key", "left")
    # What follows the half has m - exact code points in the word that asks; its own halves are a second key each.
    rest, q = F.expr("substring(read, exact + 1, length(read))"), F.col("m") - F.col("exact")
    first, last = F.floor(q / 2).cast("int"), (q - F.floor(q / 2)).cast("int")
    further = F.array(
        F.when(F.length(rest) >= first, F.struct(F.lit(FIRST).alias("part"), F.concat(F.lit(" <"), F.substring(rest, F.lit(1), first)).alias("more"))),
        F.when(F.length(rest) >= last, F.struct(F.lit(LAST).alias("part"), F.concat(F.lit(" >"), F.substring(rest, F.length(rest) - last + 1, last)).alias("more"))),
    )
    only = F.array(F.struct(F.lit(ALL).alias("part"), F.lit("").alias("more")))
    each = F.explode(F.when(F.col("large"), F.filter(further, lambda x: x.isNotNull())).otherwise(only)).alias("e")
    return rows.select("word", "n", "back", "exact", "asks", "key", each).select("word", "n", "back", "exact", "asks", "e.part", F.concat("key", "e.more").alias("key"))


def _own(word: str, other: str, exact: int, back: bool, part: int) -> bool:
    """Whether this key of the two words reports them: of the directions the forward one if both do, of a large group the first part."""
    half = len(word) - exact
    if back and other[:half] == word[:half]:
        return False
    if part == ALL:
        return True
    a, b = (word[half - 1 :: -1] if half else "", other[: len(other) - exact][::-1]) if back else (word[exact:], other[exact:])
    return (a[: len(a) // 2] == b[: len(a) // 2]) == (part == FIRST)


def near_words(words: DataFrame, ws: Workspace) -> DataFrame:
    """(word, n, other, other_n): all ordered pairs of words (word, n) that differ by one code point, each once."""

    def answer(back: bool, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Pairs of a group: rows (word, n, exact, asks, part)."""
        count = {w[::-1] if back else w: n for w, n, *_ in rows}
        known = sorted(count)
        automaton = Automaton(known)
        out: list[tuple] = []
        for word, n, exact, asks, part in rows:
            if not asks:
                continue
            for k in automaton.near(word[::-1] if back else word, exact):
                other = known[k][::-1] if back else known[k]
                if _own(word, other, exact, back, part):
                    out.append((word, n, other, count[known[k]]))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pydict(dict(zip(("word", "n", "other", "other_n"), map(list, zip(*out)))))
                out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(("word", "n", "other", "other_n"), map(list, zip(*out)))))

    def run(batches):
        # Rows come in order of their keys; keys are put together until there are enough for an automaton.
        held: list[tuple] = []
        direction, last = None, None
        for batch in batches:
            for word, n, back, exact, asks, part, key in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "back", "exact", "asks", "part", "key"))):
                if held and key != last and (back != direction or len(held) >= GROUP_WORDS):
                    yield from answer(direction, held)
                    held = []
                direction, last = back, key
                held.append((word, n, exact, asks, part))
        if held:
            yield from answer(direction, held)
        give_back()

    dealt = _dealt(words, ws)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, "key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "word string, n long, other string, other_n long")


def forms(words: DataFrame, pairs: DataFrame, ws: Workspace, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root): the near word of largest n, if that is ``ratio`` times the word's, and where forms lead."""
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"))
    rows = ws.save(rows.withColumns({c: F.when(F.col("form_n") >= ratio * F.col("n"), F.col(c)) for c in ("form", "form_n")}), "forms")
    now = ws.save(rows.filter("form is not null").select("word", F.col("form").alias("root")), "roots-0")
    step = 0
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step += 1
        new = ws.save(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots-{step}")
        ws.drop(f"roots-{step - 1}")
        now = new.select("word", "root")
        if new.filter("moved").isEmpty():
            break
    return rows.join(now, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(words: DataFrame, ws: Workspace, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words (word, n)."""
    words = ws.save(words, "words")
    return forms(words, ws.save(near_words(words, ws), "pairs"), ws, ratio)
