"""Removal of repeated byte strings by bucket-pointer refinement of sampled suffixes.

Every string of ``length`` bytes (a window) belongs to the suffix that starts at its anchor, the smallest
q-gram within it in a random order; equal windows have their anchors at equal places, so suffixes
elsewhere need no sorting. Initial buckets hold the suffixes that share their q-gram. Buckets of one suffix
end there: none of their windows repeats. The others are refined by depth, each at most twice the one before
(64, 128, 188, 200 bytes): the identifier of a string is made of the identifiers, one depth before, of its start and of a later
offset, and the rows of a bucket are grouped on it. What a depth has settled is used by the next one: a run of windows whose
bytes all occur again is repeated and only one of its kind stays beside the open runs of its bucket, runs alone in
a bucket are unrepeated, and the rest are cut at equal distances from their anchor into runs of windows
that share the next depth's bytes. At the last depth a run is one window.

Buckets are counted by partial aggregation, written and joined back, so that none must fit in a task; the plan is the
same at every size. Equal texts share one key (a 64-bit hash), and strings of a bucket one 64-bit identifier; both are taken as exact.

Cases: a null or empty text, or one shorter than ``length``, loses nothing. Repeated rows repeat all
their windows. Texts of any length pass whole, in overlapping segments. Only the named columns are
read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatia.llm.bytes_np import BYTE_VALUES, U, chunks, mix, prefix_sums, span_hash
from verbatia.llm.work import Workspace, restrict

GRAM = 64
#: Bytes of one text that are worked on at once; longer texts pass in overlapping segments.
SEGMENT = 1 << 20
_PLACE = U((1 << 24) - 1)


def _segments(column: pa.Array, length: int):
    """(first row, bytes, offsets, position of the first byte in its text)."""
    for lo, _, data, offsets in chunks(column):
        if len(data) <= SEGMENT:
            yield lo, data, offsets, 0
            continue
        for at in range(0, max(1, len(data) - length + 1), SEGMENT):
            part = data[at : at + SEGMENT + length - 1]
            yield lo, part, np.array([0, len(part)]), at


def depths(length: int, q: int, step: int) -> list[int]:
    """From q, each at most twice the one before, to ``length``; the last but one has ``step`` windows in a run."""
    out = [q]
    while out[-1] < length:
        out.append(min(2 * out[-1], length - step + 1 if out[-1] < length - step + 1 else length))
    return out


def _identifier(sums: np.ndarray, at: np.ndarray, depth: list[int]) -> np.ndarray:
    """Identifiers of the strings at the last of the depths: of two identifiers of the depth before, the second at a later offset."""
    if len(depth) == 1:
        return mix(span_hash(sums, at, at + depth[0]))
    here = _identifier(sums, at, depth[:-1])
    return mix(here * U(0xA24BAED4963EE407) + _identifier(sums, at + depth[-1] - depth[-2], depth[:-1]))


def _owned(data: np.ndarray, offsets: np.ndarray, length: int, q: int):
    """Runs of windows with one anchor: (row, first and last window, anchor, gram, identifier of all bytes).

    A window's anchor is its smallest q-gram in a random order, leftmost among equals, so equal windows
    have their anchors at the same place.
    """
    n, w = len(data), length - q + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U),) * 2
    sums = prefix_sums(BYTE_VALUES[data])
    at = np.arange(n - q + 1)
    gram = _identifier(sums, at, [q])
    low = (gram & ~_PLACE) | at.astype(U)
    width = 1
    while 2 * width <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < w:
        low = np.minimum(low[: len(low) - (w - width)], low[w - width :])
    anchor = (low & _PLACE).astype(np.int64)
    edge = np.zeros(len(anchor) + 1, np.int64)
    long = np.diff(offsets) >= length
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - length + 1, -1)
    fits = np.cumsum(edge[:-1]) > 0
    change = np.ones(len(anchor) + 1, bool)
    change[1:-1] = (anchor[1:] != anchor[:-1]) | ~fits[:-1] | ~fits[1:]
    inner = offsets[:-1][long]
    change[inner] = True
    first, last = np.flatnonzero(change[:-1] & fits), np.flatnonzero(change[1:] & fits)
    p = anchor[first]
    whole = mix(span_hash(sums, first, last + length) + mix(((p - first) << 32 | (last - first)).astype(U)))
    return np.searchsorted(offsets, first, "right") - 1, first, last, p, gram[p], whole


def _place(first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return first << 24 | (last - first) << 12 | (anchor - first)


def anchored(docs: DataFrame, length: int, q: int) -> DataFrame:
    """Depth q: every run of windows with one anchor, its bucket (the anchor's q-gram) and its whole."""

    def run(batches):
        for batch in batches:
            keys = batch.column("text_key")
            for lo, data, offsets, base in _segments(batch.column("text"), length):
                row, first, last, p, gram, whole = _owned(data, offsets, length, q)
                here = offsets[row] - base
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(lo + row)), pa.array(_place(first - here, last - here, p - here)), pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64))],
                    ["text_key", "place", "bucket", "whole"],
                )

    return docs.select("text_key", "text").mapInArrow(run, "text_key long, place long, bucket long, whole long")


def deepened(texts: DataFrame, runs: DataFrame, length: int, depth: list[int]) -> DataFrame:
    """Runs cut into runs of windows that share the bytes of the last depth, at equal distances from their
    anchor; a run's bucket is the identifier of those bytes."""
    step = length - depth[-1] + 1

    def run(batches):
        for batch in batches:
            keys, places, opens = (batch.column(c) for c in ("text_key", "places", "opens"))
            for lo, hi, data, offsets in chunks(batch.column("text"), SEGMENT):
                sums = prefix_sums(BYTE_VALUES[data])
                many = np.array([len(places[i]) for i in range(lo, hi)])
                place = np.concatenate([places[i].values.to_numpy() for i in range(lo, hi)])
                is_open = np.concatenate([opens[i].values.to_numpy(zero_copy_only=False) for i in range(lo, hi)])
                row = np.repeat(np.arange(hi - lo), many)
                first, span, rel = place >> 24, (place >> 12) & 4095, place & 4095
                near, far = (rel - span) // step, rel // step
                each = far - near + 1
                at = np.repeat(np.arange(len(place)), each)
                g = near[at] + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                anchor = first[at] + rel[at]
                a, b = np.maximum(first[at], anchor - step * g - step + 1), np.minimum(first[at] + span[at], anchor - step * g)
                here = offsets[row[at]]
                bucket = mix(_identifier(sums, here + anchor - step * g, depth) + mix((g + 1).astype(U)))
                whole = mix(span_hash(sums, here + a, here + b + length) + mix(((anchor - a) << 32 | (b - a) << 12 | g).astype(U)))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(lo + row[at])), pa.array(_place(a, b, anchor)), pa.array(bucket.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(is_open[at])],
                    ["text_key", "place", "bucket", "whole", "open"],
                )

    once = runs.groupBy("text_key", "place").agg(F.max("open").alias("open"))
    per_text = once.groupBy("text_key").agg(F.collect_list(F.struct("place", "open")).alias("r"))
    rows = texts.join(per_text, "text_key").select("text_key", "text", F.col("r.place").alias("places"), F.col("r.open").alias("opens"))
    return rows.mapInArrow(run, "text_key long, place long, bucket long, whole long, open boolean")


def _settle(runs: DataFrame, ws: Workspace, tag: str) -> tuple[DataFrame, DataFrame]:
    """Runs found repeated whole, and what the next depth needs: open runs and one of each repeated run beside them.

    Counts are written before they are joined, so that the rows of one bucket or string may be split over tasks.
    """
    shared = runs.groupBy("bucket").agg(F.count("*").alias("m"), (F.min("whole") != F.max("whole")).alias("mixed"))
    shared = ws.save(shared.filter("m > 1").select("bucket", "mixed"), f"{tag}-shared")
    live = ws.save(runs.join(shared, "bucket").drop("bucket"), f"{tag}-live")
    wholes = live.groupBy("whole").agg(F.count("*").alias("c"), F.min(F.struct("text_key", "place")).alias("one"))
    wholes = ws.save(wholes.filter("c > 1").select("whole", "one"), f"{tag}-wholes")
    repeated = F.col("one").isNotNull()
    first = (F.col("one.text_key") == F.col("text_key")) & (F.col("one.place") == F.col("place"))
    stays = F.col("mixed") & F.when(F.col("open") & ~repeated, True).otherwise(F.coalesce(first, ~F.col("open")) | ~F.col("open"))
    seen = live.join(wholes, "whole", "left").select("text_key", "place", (F.col("open") & repeated).alias("done"), stays.alias("stays"), (F.col("open") & ~repeated).alias("open"))
    seen = ws.save(seen.filter("done or stays"), f"{tag}-seen")
    ws.drop(f"{tag}-shared", f"{tag}-live", f"{tag}-wholes")
    return seen.filter("done").select("text_key", "place"), seen.filter("stays").select("text_key", "place", "open")


def repeated_spans(docs: DataFrame, ws: Workspace, length: int = 200, q: int = GRAM, step: int = 13) -> DataFrame:
    """Rows (text_key, spans): maximal ranges of bytes covered by repeated strings; docs has text_key and text."""
    depth = depths(length, q, step)
    every, todo = _settle(anchored(docs, length, q).withColumn("open", F.lit(True)), ws, "depth0")
    wanted = ws.save(todo.select("text_key").distinct(), "wanted")
    texts = ws.save(restrict(docs.select("text_key", "text"), wanted, ["text_key"]).groupBy("text_key").agg(F.first("text").alias("text")), "texts")
    for i in range(1, len(depth)):
        runs = ws.save(deepened(texts, todo, length, depth[: i + 1]), f"runs{i}")
        done, todo = _settle(runs, ws, f"depth{i}")
        ws.drop(f"runs{i}")
        every = every.union(done)
    ws.drop("texts", "wanted")
    begin, span = F.shiftright("place", 24), F.shiftright("place", 12).bitwiseAND(4095)
    ranges = every.select("text_key", begin.alias("s"), (begin + span + length).alias("e")).distinct()

    def merge(batches):
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        for batch in batches:
            out = []
            for x in batch.column("r"):
                v = x.values
                s, e = v.field("s").to_numpy(), v.field("e").to_numpy()
                order = np.lexsort((e, s))
                s, e = s[order], np.maximum.accumulate(e[order])
                new = np.concatenate([[True], s[1:] > e[:-1]])
                ends = e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(e) - 1]])]
                out.append([{"s": a, "e": b} for a, b in zip(s[new].tolist(), ends.tolist())])
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(out, kind)], ["text_key", "spans"])

    per_text = ranges.groupBy("text_key").agg(F.collect_list(F.struct("s", "e")).alias("r"))
    return ws.save(per_text.mapInArrow(merge, "text_key long, spans array<struct<s:long,e:long>>"), "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """Rows (doc_id, n_bytes, spans, kept): removed byte ranges and the remaining bytes of every text."""
    ws = Workspace(docs.sparkSession, "repeats")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    spans = repeated_spans(rows, ws, length)

    def cut(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                part, kept = batch.slice(lo, hi - lo), []
                for d, ranges in enumerate(part.column("spans")):
                    at, parts = offsets[d], []
                    for r in ranges.as_py():
                        parts.append(data[at : offsets[d] + r["s"]].tobytes())
                        at = offsets[d] + r["e"]
                    kept.append(b"".join([*parts, data[at : offsets[d + 1]].tobytes()]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), part.column("spans"), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    sized = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    keys = spans.select("text_key")
    hit = restrict(sized, keys, ["text_key"]).join(spans, "text_key").select("doc_id", "n_bytes", "spans", "text")
    hit = hit.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<s:long,e:long>>, kept binary")
    free = restrict(sized, keys, ["text_key"], "left_anti")
    return hit.union(free.select("doc_id", "n_bytes", F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)"), F.col("text").cast("binary")))


def repeat_digest(rows: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
