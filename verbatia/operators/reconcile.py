"""Runs that a search has found and spans that a writer's cue announces, brought together: one candidate a place.

Announced spans are taken in order, each against the candidates as they stand by then. A span that overlaps none is a candidate of its own.
One that a candidate equals, or holds with the rest of its window, only marks the candidate as announced. A span and the runs that it
overlaps become one candidate over all of them if that hull lies inside the announced window and no run is announced yet; the runs' places in
the works, widened by the words that the hull adds, stay as hints. Any other overlap leaves the run as it is, announced if it holds the span.

Rows are dealt by document and sorted, and a task holds the candidates of one document at a time. Candidates never overlap, so a span
meets its neighbours by bisection.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(order=True)
class Candidate:
    """Words start to end of a document; the places in works that speak for it."""

    start: int
    end: int
    source: str = field(compare=False)
    announced: bool = field(compare=False)
    hints: list[tuple] = field(compare=False)


class Candidates:
    """Disjoint candidates of one document, in order."""

    def __init__(self) -> None:
        self.rows: list[Candidate] = []

    def add(self, c: Candidate) -> None:
        insort(self.rows, c)

    def over(self, start: int, end: int) -> slice:
        """The candidates that overlap a range of words."""
        lo = bisect_left(self.rows, start, key=lambda c: c.start)
        lo -= lo > 0 and self.rows[lo - 1].end > start
        return slice(lo, bisect_left(self.rows, end, key=lambda c: c.start))

    def announce(self, start: int, end: int, window: tuple[int, int], hints: list[tuple]) -> None:
        at = self.over(start, end)
        met = self.rows[at]
        if not met:
            self.add(Candidate(start, end, "cue", True, hints))
            return
        low, high = min(start, met[0].start), max(end, met[-1].end)
        inside = window[0] <= low and high <= window[1]
        held = len(met) == 1 and (met[0].start, met[0].end) == (low, high)
        if held or not inside or any(c.announced or c.source != "run" for c in met):
            for c in met:
                c.announced |= c.start <= start and end <= c.end
            return
        wider = [(work, max(0, p0 - (c.start - low)), p1 + (high - c.end)) for c in met for work, p0, p1 in c.hints]
        self.rows[at] = [Candidate(low, high, "cue", True, wider)]


def reconcile(runs: DataFrame, announced: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, d0, d1, source, announced, hints): candidates of documents.

    runs(key, d0, d1, work, b0, b1): disjoint runs, the places of a run that occurs several times in several rows. announced(key,
    d0, d1, w0, w1, work, b0, b1): spans and their windows. Hints may reach beyond the end of a work.
    """
    place = F.struct(F.col("work").cast("long").alias("work"), F.col("b0").cast("long").alias("p0"), F.col("b1").cast("long").alias("p1"))
    cols = [F.col(c).cast("long").alias(c) for c in ("d0", "d1")]
    found = runs.groupBy(key, *cols).agg(F.array_sort(F.collect_set(place)).alias("hints")).select(key, F.lit(0).alias("turn"), "d0", "d1", F.lit(0).cast("long").alias("w0"), F.lit(0).cast("long").alias("w1"), "hints")
    said = announced.select(key, F.lit(1).alias("turn"), *cols, F.col("w0").cast("long").alias("w0"), F.col("w1").cast("long").alias("w1"), F.array(place).alias("hints"))
    hint = pa.list_(pa.struct([("work", pa.int64()), ("p0", pa.int64()), ("p1", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, state, fresh = None, Candidates(), True

        def rows() -> Iterator[pa.RecordBatch]:
            if state.rows:
                n = len(state.rows)
                columns = [pa.array([doc] * n, kind), *(pa.array([getattr(c, a) for c in state.rows]) for a in ("start", "end", "source", "announced"))]
                hints = pa.array([[dict(zip(("work", "p0", "p1"), h)) for h in c.hints] for c in state.rows], hint)
                yield pa.RecordBatch.from_arrays([*columns, hints], [key, "d0", "d1", "source", "announced", "hints"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for name, turn, d0, d1, w0, w1, hints in zip(*(c.to_pylist() for c in batch.columns)):
                if fresh or name != doc:
                    yield from rows()
                    doc, state, fresh = name, Candidates(), False
                own = [(h["work"], h["p0"], h["p1"]) for h in hints]
                if turn:
                    state.announce(d0, d1, (w0, w1), own)
                else:
                    state.add(Candidate(d0, d1, "run", False, own))
        yield from rows()

    line = found.unionByName(said).repartition(key).sortWithinPartitions(key, "turn", "d0", "d1", "w0", "w1", "hints")
    return line.mapInArrow(run, f"`{key}` {runs.schema[key].dataType.simpleString()}, d0 long, d1 long, source string, announced boolean, hints array<struct<work:long,p0:long,p1:long>>")


def merge(candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, d0, d1, sources, announced, hints, others): disjoint candidates of all kinds; none replaces or shrinks one of a higher rank.

    candidates(key, rank, d0, d1, source, announced, hints) are taken by rank, then by start, the longer first. One that overlaps candidates
    already taken gives its source and mark to the first taken of them, and its hints if that has none; its own span stays in ``others`` with how
    it lies to that. Words are halfopen ranges; an empty range meets nothing and is left out.
    """
    hint = "array<struct<work:long,p0:long,p1:long>>"
    out = f"`{key}` {candidates.schema[key].dataType.simpleString()}, d0 long, d1 long, sources array<string>, announced boolean, hints {hint}, others array<struct<source:string,d0:long,d1:long,relation:string>>"

    def relation(s: int, e: int, s2: int, e2: int) -> str:
        if (s, e) == (s2, e2):
            return "equal"
        return "inside" if s2 <= s and e <= e2 else "around" if s <= s2 and e2 <= e else "crossing"

    def rows(doc: object, kept: list[dict], kind: pa.DataType, schema: pa.Schema) -> pa.RecordBatch:
        for c in kept:
            c["sources"] = sorted(c["sources"])
        columns = [pa.array([doc] * len(kept), kind), *(pa.array([c[f.name] for c in kept], f.type) for f in list(schema)[1:])]
        return pa.RecordBatch.from_arrays(columns, [key, *(f.name for f in list(schema)[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.list_(pa.struct([("work", pa.int64()), ("p0", pa.int64()), ("p1", pa.int64())]))
        other = pa.list_(pa.struct([("source", pa.string()), ("d0", pa.int64()), ("d1", pa.int64()), ("relation", pa.string())]))
        schema = pa.schema([("key", pa.int64()), ("d0", pa.int64()), ("d1", pa.int64()), ("sources", pa.list_(pa.string())), ("announced", pa.bool_()), ("hints", place), ("others", other)])
        doc, kept, taken, kind = None, [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for name, _, d0, d1, source, announced, hints in zip(*(c.to_pylist() for c in batch.columns)):
                if kept and name != doc:
                    yield rows(doc, kept, kind, schema)
                    kept = []
                doc = name
                lo = bisect_left(kept, d0, key=lambda c: c["d0"])
                lo -= lo > 0 and kept[lo - 1]["d1"] > d0
                met = kept[lo : bisect_left(kept, d1, key=lambda c: c["d0"])]
                if not met:
                    taken += 1
                    kept.insert(lo, {"d0": d0, "d1": d1, "sources": {source}, "announced": announced, "hints": hints, "others": [], "turn": taken})
                    continue
                first = min(met, key=lambda c: c["turn"])
                first["sources"].add(source)
                first["announced"] |= announced
                first["hints"] = first["hints"] or hints
                first["others"].append({"source": source, "d0": d0, "d1": d1, "relation": relation(d0, d1, first["d0"], first["d1"])})
        if kept:
            yield rows(doc, kept, kind, schema)

    cols = [F.col(c).cast("long").alias(c) for c in ("d0", "d1")]
    line = candidates.filter("d0 < d1").select(key, "rank", *cols, "source", "announced", F.col("hints").cast(hint).alias("hints"))
    line = line.repartition(key).sortWithinPartitions(key, "rank", "d0", F.desc("d1"), "source", "hints")
    return line.mapInArrow(run, out)
