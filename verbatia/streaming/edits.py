"""Edits of a text, one after the other, moving the findings in it: in batch and as a stream with the findings as state.

An edit (start, old_end, new_end) replaces characters start to old_end of the text as it stands by then with new_end - start characters. A
finding whose zone lies before it stays, one whose zone lies behind it moves; if the edit touches the zone, the finding is stale, its points
go to the edit's nearer edge, and one without characters left is removed. The zone moves with its points.

State: the findings of one document. Edits of a document are taken in the order of their numbers; in a stream each batch holds numbers
beyond those of the batches before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FIELDS = ("finding_id", "s", "e", "z0", "z1", "stale")
DDL = "finding_id long, s long, e long, z0 long, z1 long, stale boolean"
#: Rows of findings and of edits in one table, as a stream brings them.
EVENTS = "turn int, seq long, finding_id long, s long, e long, z0 long, z1 long, start long, old_end long, new_end long"


@dataclass
class Finding:
    finding_id: int
    s: int
    e: int
    z0: int
    z1: int
    stale: bool = False


def moved(point: int, start: int, old_end: int, new_end: int, end: bool) -> int:
    """Where a point of the text goes in an edit; one that was replaced goes to the edit's start or end."""
    if point <= start:
        return point
    return point + new_end - old_end if point >= old_end else new_end if end else start


def apply_edit(findings: list[Finding], start: int, old_end: int, new_end: int) -> list[Finding]:
    out = []
    for f in findings:
        if f.z1 >= start:
            ends = [moved(p, start, old_end, new_end, end) for p, end in ((f.s, False), (f.e, True), (f.z0, False), (f.z1, True))]
            if f.z0 > old_end:
                ends = [p + new_end - old_end for p in (f.s, f.e, f.z0, f.z1)]
            elif ends[1] <= ends[0]:
                continue
            f = Finding(f.finding_id, *ends, f.stale or f.z0 <= old_end)
        out.append(f)
    return out


def events(findings: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings (key, finding_id, s, e, z0, z1) and edits (key, seq, start, old_end, new_end) as rows of one table."""
    none = lambda *names: [F.lit(None).cast("long").alias(c) for c in names]
    long = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    a = findings.select(key, F.lit(0).alias("turn"), F.lit(0).cast("long").alias("seq"), *long(*FIELDS[:5]), *none("start", "old_end", "new_end"))
    return a.unionByName(edits.select(key, F.lit(1).alias("turn"), *long("seq"), *none(*FIELDS[:5]), *long("start", "old_end", "new_end")))


def _step(state: list[Finding], row) -> list[Finding]:
    turn, _, finding_id, s, e, z0, z1, start, old_end, new_end = row
    return apply_edit(state, start, old_end, new_end) if turn else [*state, Finding(finding_id, s, e, z0, z1)]


def edited(findings: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, finding_id, s, e, z0, z1, stale): the findings that are left after all edits of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, state, kind = None, None, None

        def rows() -> Iterator[pa.RecordBatch]:
            if state:
                columns = [pa.array([doc] * len(state), kind), *(pa.array([getattr(f, c) for f in state]) for c in FIELDS)]
                yield pa.RecordBatch.from_arrays(columns, [key, *FIELDS])

        for batch in batches:
            kind = batch.schema.field(0).type
            for name, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or name != doc:
                    yield from rows()
                    doc, state = name, []
                state = _step(state, row)
        yield from rows()

    line = events(findings, edits, key).repartition(key).sortWithinPartitions(key, "turn", "seq", "finding_id")
    return line.mapInArrow(run, f"`{key}` {findings.schema[key].dataType.simpleString()}, {DDL}")


def edited_stream(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """The findings of a document after every batch of a stream of ``events``: all of them as they stand then (update mode)."""
    kind = rows.schema[key].dataType.simpleString()

    def fold(keys, pdfs, state: GroupState):
        now = [Finding(*f) for f in zip(*state.get)] if state.exists else []
        for row in pd.concat(pdfs).sort_values(["turn", "seq", "finding_id"])[[c.split()[0] for c in EVENTS.split(", ")]].astype(object).itertuples(index=False):
            now = _step(now, [None if pd.isna(x) else int(x) for x in row])
        state.update(tuple([getattr(f, c) for f in now] for c in FIELDS))
        if now:
            yield pd.DataFrame([{key: keys[0], **{c: getattr(f, c) for c in FIELDS}} for f in now])

    held = ", ".join(f"{c} array<{t}>" for c, t in (x.split() for x in DDL.split(", ")))
    return rows.groupBy(key).applyInPandasWithState(fold, f"`{key}` {kind}, {DDL}", held, "update", GroupStateTimeout.NoTimeout)
