"""MinHash near-duplicate detection with odd sketches.

A document's set holds the hashes of its distinct word shingles (words: A-Z lower-cased, runs without
ASCII white space; a document of fewer words has its whole sequence as one shingle). Documents with
equal sets are one node from the start. A node has ``bands`` * ``rows`` MinHash samples. Nodes that
agree on all rows of a band meet in a bucket; a pair at the threshold of 0.8 misses every bucket with
probability (1 - 0.8 ** rows) ** bands, 1e-7 for 40 bands of 5 rows. Two nodes that
meet are compared by their odd sketches: each of the samples (its number and its value) flips one bit of a bitmap of
``BITS`` bits. With x bits in which two bitmaps of k samples differ, 1 + BITS / 4k * ln(1 - 2x / BITS) estimates the similarity
of the sets, most precisely where it is high. Pairs whose estimate is ``SLACK`` or more below the threshold (over six standard
deviations of the estimate at the threshold) are no candidates, nor are pairs whose sizes rule the threshold out. A second odd
sketch, of the shingles themselves (all whose hash is below a threshold, which is 1 for sets of up to ``SAMPLE`` shingles and halves for every
doubling beyond), rules out most of the others: its XOR never counts more bits than the shingles in which the sampled sets
differ, so a pair with more than any pair at the threshold can have (exactly, for whole sets; by ``DEVIATIONS`` of the
sampling beyond) is no candidate. Candidates are confirmed on
their full sets: 100 * intersection >= 100 * threshold * union.

Buckets are never expanded into all their pairs: first every node is checked against the most similar
first node of its buckets; then, in buckets that still hold several components, the nodes outside the bucket's
largest component are compared with the nodes of other components. No bucket is capped, and a link
between two components that share a bucket is found whichever bucket it is.

A shingle is identified by 64 bits and a set by 64 bits of two mixed sums; both are taken as exact.

Cases: documents without words or text have size 0, link with nothing and stand for themselves.
Repeated rows are equal sets. Rows with a null id take part; a component is named by its smallest
non-null id. Texts of any length pass whole. Only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatia.llm.bytes_np import SPACED, U, Words, chunks, mix, shingles
from verbatia.llm.work import Workspace, bound_batches, components, give_back, restrict

BANDS, ROWS = 40, 5
SKETCH_WORDS = 12
BITS = 64 * SKETCH_WORDS
#: How far below the threshold an estimate may be; 200 samples in 768 bits have a standard deviation of 0.032 at 0.8.
SLACK = 0.2
#: Shingles of a set that its second sketch holds at most, on average, its words, and standard deviations by which a sample may differ more than its set.
SAMPLE, WHOLE_WORDS, DEVIATIONS = 1024, 16, 6.0
_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
_WHOLE = [f"w{i}" for i in range(WHOLE_WORDS)]


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(11)
    return r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def estimate(samples: int) -> Column:
    """Similarity of the sets of sides a and b by the bits in which their odd sketches differ; null beyond the sketches' reach."""
    share = F.lit(1.0) - 2.0 * _apart(_SKETCH) / BITS
    return F.when(share > 0, F.lit(1.0) + F.log(share) * BITS / (4.0 * samples))


def most_apart(similarity: float, samples: int) -> int:
    """The most bits in which odd sketches may differ for the estimate, which falls with every bit, to be above a similarity."""
    return math.ceil(BITS * (1 - math.exp(4 * samples * (similarity - 1) / BITS)) / 2) - 1


def alike(threshold: int, samples: int) -> Column:
    """Whether sides a and b may be similar enough by their sizes and sketches; threshold in hundredths."""
    sizes = 100 * F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n")
    both = F.col("a.n") + F.col("b.n")
    differ = both - 2 * F.ceil(threshold * both / (100 + threshold))
    sampled = differ / F.pow(F.lit(2.0), "a.level")
    most = F.when(F.col("a.level") == 0, differ).otherwise(sampled + DEVIATIONS * F.sqrt(sampled) + 1)
    # Samples of different levels (sizes on either side of a doubling) are not compared.
    bound = (F.col("a.level") != F.col("b.level")) | (_apart(_WHOLE) <= most)
    return sizes & (_apart(_SKETCH) <= most_apart(threshold / 100 - SLACK, samples)) & bound


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """Rows (doc_id, text_key, n, node, keys, level, s0.., w0..): set size, set identity, band keys, sampling level, odd sketches of the samples and of the shingles."""
    samples = bands * rows
    mul, add = _multipliers(samples)
    schema = "doc_id long, text_key long, n long, node long, keys array<long>, level int, " + ", ".join(f"{s} long" for s in [*_SKETCH, *_WHOLE])

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                h, at = shingles(Words(data, offsets, SPACED), shingle)
                size = np.diff(at)
                full = np.flatnonzero(size)
                keys = np.zeros((hi - lo, bands), U)
                node = np.zeros(hi - lo, U)
                sketch = np.zeros((hi - lo, BITS), np.uint8)
                if len(full):
                    begin = at[:-1][full]
                    node[full] = mix(np.add.reduceat(mix(h), begin) ^ (np.add.reduceat(mix(h * U(0xC2B2AE3D27D4EB4F)), begin) * U(3) + size[full].astype(U)))
                    x = (h >> U(32)).astype(np.uint32)
                    band = None
                    for i in range(samples):
                        low = np.minimum.reduceat(x * mul[i] + add[i], begin).astype(U)
                        v = mix(low + U(i << 32))
                        sketch[full, (v % U(BITS)).astype(np.int64)] ^= 1
                        band = v if i % rows == 0 else mix(band * U(31) + v)
                        if i % rows == rows - 1:
                            keys[full, i // rows] = mix(band + U(i))
                level = np.ceil(np.log2(np.maximum(1, size / SAMPLE))).astype(np.int64)
                row, kind = np.repeat(np.arange(hi - lo), size), mix(h ^ U(0x94D049BB133111EB))
                taken = kind < (U(0xFFFFFFFFFFFFFFFF) >> level[row].astype(U))
                cell = row[taken] * (64 * WHOLE_WORDS) + (kind[taken] % U(64 * WHOLE_WORDS)).astype(np.int64)
                whole = (np.bincount(cell, minlength=(hi - lo) * 64 * WHOLE_WORDS) & 1).astype(np.uint8).reshape(hi - lo, -1)
                sketch = np.concatenate([sketch, whole], axis=1)
                words = np.packbits(sketch, axis=1, bitorder="little").view("<i8")
                flat = pa.array(keys[full].view(np.int64).ravel())
                ends = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
                cols = [batch.column("doc_id").slice(lo, hi - lo), batch.column("text_key").slice(lo, hi - lo), pa.array(size), pa.array(node.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(level.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(words[:, i]) for i in range(words.shape[1])], ["doc_id", "text_key", "n", "node", "keys", "level", *_SKETCH, *_WHOLE])
        give_back()

    return docs.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows (node, grams): all shingles of a text."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                h, at = shingles(Words(data, offsets, SPACED), shingle)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))], ["node", "grams"])
        give_back()

    return docs.select("node", "text").mapInArrow(run, "node long, grams array<long>")


def _apart(sketch: list[str]) -> Column:
    """Bits in which a sketch of sides a and b differs."""
    total = F.bit_count(F.col(f"a.{sketch[0]}").bitwiseXOR(F.col(f"b.{sketch[0]}")))
    for s in sketch[1:]:
        total = total + F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}")))
    return total


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Rows (doc_id, text_key, n_shingles, component_id, kept); threshold in hundredths."""
    bound_batches(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "near_dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    signed = ws.save(signatures(docs, shingle, bands, rows), "signed")
    members = signed.select("doc_id", "text_key", "n", "node")
    # One row for each distinct set; the text that stands for it is found again by its key.
    head = signed.filter("n > 0").groupBy("node").agg(F.min(F.struct("text_key", "doc_id")).alias("of"), F.count("*").alias("copies"))
    nodes = signed.alias("g").join(head.alias("h"), (F.col("g.node") == F.col("h.node")) & (F.col("g.text_key") == F.col("h.of.text_key")) & F.col("g.doc_id").eqNullSafe(F.col("h.of.doc_id")))
    nodes = ws.save(nodes.select("g.node", "g.text_key", "g.n", "g.keys", "g.level", *[f"g.{s}" for s in [*_SKETCH, *_WHOLE]]).dropDuplicates(["node"]), "nodes")
    sketches = nodes.select("node", "n", "level", *_SKETCH, *_WHOLE)
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    similar = alike(threshold, bands * rows)

    def confirmed(pairs: DataFrame, tag: str) -> DataFrame:
        """Pairs whose full sets are similar enough."""
        wanted = ws.save(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), f"{tag}-wanted")
        texts = restrict(nodes.select("node", "text_key"), wanted, ["node"])
        texts = ws.save(texts.dropDuplicates(["text_key"]), f"{tag}-keys")
        found = restrict(docs.select("text_key", "text"), texts.select("text_key"), ["text_key"]).join(texts, "text_key")
        sets = ws.save(shingle_sets(found, shingle).dropDuplicates(["node"]), f"{tag}-sets")
        x = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
        common = F.size(F.array_intersect("ga", "gb"))
        return ws.save(x.filter(100 * common >= threshold * (F.size("ga") + F.size("gb") - common)).select("a", "b"), f"{tag}-links")

    # First pass: each node against the most similar of its buckets' first nodes.
    first = buckets.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("m")).filter("m > 1")
    shared = ws.save(restrict(buckets, ws.save(first.select("key", "first"), "first"), ["key"], "inner"), "shared")
    stars = shared.filter("node <> first").select("node", "first").distinct()
    close = stars.alias("p").join(sketches.alias("a"), F.col("p.node") == F.col("a.node")).join(sketches.alias("b"), F.col("p.first") == F.col("b.node")).filter(similar)
    close = close.groupBy(F.col("a.node").alias("a")).agg(F.max_by("p.first", F.struct(estimate(bands * rows), "p.first")).alias("b"))
    links = confirmed(ws.save(close, "stars"), "first")
    comps = ws.save(components(links, ws, "cc1"), "comps1")

    # Second pass: links between components that share a bucket.
    placed = shared.select("node", "key").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = ws.save(placed, "placed")
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("m"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("m", "comp")).alias("largest")).filter("comps > 1")
    mixed = ws.save(mixed.select("key", "largest"), "mixed")
    inside = ws.save(placed.join(mixed, "key").join(nodes.select("node", "n", "level", "keys", *_SKETCH, *_WHOLE), "node"), "inside")
    ws.drop("placed")
    a, b = inside.filter("comp <> largest").alias("a"), inside.alias("b")
    # A pair may meet in many buckets; it counts in the first of them.
    once = F.col("a.key") == F.array_min(F.array_intersect("a.keys", "b.keys"))
    across = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.comp") != F.col("b.comp")) & ((F.col("b.comp") == F.col("b.largest")) | (F.col("a.node") < F.col("b.node"))) & similar & once)
    pairs = ws.save(across.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct(), "across")
    links = links.union(confirmed(pairs, "second"))
    comps = ws.save(components(links, ws, "cc2"), "comps2")

    # Components are named by node; each step is written, so that a large component's rows may be split over tasks.
    placed = members.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(comps, "node", "left")
    placed = ws.save(placed.select("node", "least", F.coalesce("comp", "node").alias("comp")), "by_node")
    named = ws.save(placed.groupBy("comp").agg(F.min("least").alias("component_id")), "named")
    labels = ws.save(restrict(placed, named, ["comp"], "inner").select("node", "component_id"), "labels")
    out = members.filter("n > 0").join(labels, "node").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id")
    out = out.union(members.filter("n = 0").select("doc_id", "text_key", "n", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
