"""Embedding near-duplicates with a pivot-permutation index.

Pivots come from a bounded sample of about ``SAMPLE`` vectors of each length (at most ``SAMPLE_BYTES``), those with the smallest hashes; their number grows with the
square root of the vectors, so that the lists and the work on each vector do too, and up to ``SPREAD`` of them are chosen far apart. A vector is described by
its ``nearest`` most similar pivots in order. The inverted list of a pivot holds the vectors whose first
pivot it is; a vector is looked up in the lists of all pivots of its description, and every pair met there that shares at least
``share`` pivots is verified by its cosine in double precision. Vectors that are equal are one node.
The index holds every vector; recall against brute force is tested.

Lists are cut into blocks of ``BLOCK`` vectors, and looked-up vectors likewise, so that a task compares
two bounded blocks whatever the size of a list; a task gives back, for each vector, how many vectors it
is linked to and one edge to its block's component, never the pairs. A pair that both ends look up is counted once
for each end.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and
stand for themselves. Vectors of different lengths are not compared. Repeated rows are separate rows of
one node. Rows with null ids count as links of others; a component is named by its smallest non-null id. Only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatia.llm.work import Workspace, components

SAMPLE, SAMPLE_BYTES = 16384, 32 << 20
SPREAD = 2048
BLOCK = 1024


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Unit vectors far apart: each next one is least similar to those chosen."""
    best = np.full(len(sample), -2.0)
    chosen, at = [], 0
    if n > SPREAD:
        return sample[:n]
    for _ in range(min(n, len(sample))):
        chosen.append(at)
        best = np.maximum(best, sample @ sample[at])
        at = int(np.argmin(best))
        if best[at] > 1 - 1e-9:
            break
    return sample[chosen]


def pivot_count(many: int, sampled: int) -> int:
    """Pivots for so many vectors: about four times the square root, of the sampled ones."""
    return int(min(sampled, max(16, 4 * many**0.5)))


def _nodes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id, node, dim, vector bytes): node is null for vectors that link with nothing."""

    def run(batches):
        for batch in batches:
            col = batch.column("v")
            nodes, dims, raw = [], [], []
            for x in col:
                v = np.array([np.nan if y is None else y for y in x.as_py()], np.float64) if x.is_valid else np.zeros(0)
                top = np.abs(v).max() if len(v) else 0.0
                if not top or not np.isfinite(v).all():
                    nodes.append(None), dims.append(0), raw.append(None)
                    continue
                b = (v + 0.0).tobytes()
                nodes.append(int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True))
                dims.append(len(v)), raw.append(b)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nodes, pa.int64()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "node", "dim", "raw"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, node long, dim int, raw binary")


def _unit(raw) -> np.ndarray:
    m = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _describe(nodes: DataFrame, pivots: dict[int, np.ndarray], nearest: int) -> DataFrame:
    """Rows (node, copies, dim, raw, perm): the description's pivots in order."""
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            perm = np.empty(len(dims), object)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                p = shared.value[int(dim)]
                raw = batch.column("raw").take(pa.array(own)).to_pylist()
                for at in range(0, len(own), 4096):
                    s = _unit(raw[at : at + 4096]) @ p.T
                    k = min(nearest, len(p))
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    order = np.lexsort((top, -np.take_along_axis(s, top, 1)), axis=1)
                    for i, row in zip(own[at : at + 4096], np.take_along_axis(top, order, 1)):
                        perm[i] = row.astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), batch.column("dim"), batch.column("raw"), pa.array(list(perm), pa.list_(pa.int32()))], ["node", "copies", "dim", "raw", "perm"])

    return nodes.select("node", "copies", "dim", "raw").mapInArrow(run, "node long, copies long, dim int, raw binary, perm array<int>")


def _compare(threshold: float, share: int):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        kept, asked = rows[rows.home], rows[~rows.home]
        empty = pd.DataFrame({"node": [], "links": [], "other": []}).astype("int64")
        if kept.empty or asked.empty:
            return empty
        a, b = np.stack(asked.perm.to_list()), np.stack(kept.perm.to_list())
        ids, at = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
        hot = [np.zeros((len(x), len(ids)), np.float32) for x in (a, b)]
        hot[0][np.arange(len(a))[:, None], at[: a.size].reshape(a.shape)] = 1
        hot[1][np.arange(len(b))[:, None], at[a.size :].reshape(b.shape)] = 1
        candidate = hot[0] @ hot[1].T >= min(share, a.shape[1])
        an, bn = asked.node.to_numpy(), kept.node.to_numpy()
        candidate &= an[:, None] != bn[None, :]
        if not candidate.any():
            return empty
        link = candidate & (_unit(asked.raw.to_list()) @ _unit(kept.raw.to_list()).T >= threshold)
        # The kept end counts here too unless it looks up the asked one's list itself.
        back = ~(hot[1][:, np.searchsorted(ids, a[:, 0])].T > 0)
        i, j = link.any(axis=1), link.any(axis=0)
        # Components of the block's links: the least label of either side until nothing changes.
        label = np.arange(len(a) + len(b))
        la, lb, big = label[: len(a)], label[len(a) :], len(label)
        while True:
            na = np.minimum(la, np.where(link, lb[None, :], big).min(axis=1))
            nb = np.minimum(lb, np.where(link, na[:, None], big).min(axis=0))
            if (na == la).all() and (nb == lb).all():
                break
            la, lb = na, nb
        every = np.concatenate([an, bn])
        out = [
            (an[i], (link * kept.copies.to_numpy()[None, :]).sum(axis=1)[i], every[la[i]]),
            (bn[j], ((link & back) * asked.copies.to_numpy()[:, None]).sum(axis=0)[j], every[lb[j]]),
        ]
        return pd.DataFrame({c: np.concatenate([x[k] for x in out]).astype("int64") for k, c in enumerate(("node", "links", "other"))})

    return compare


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, nearest: int = 12, share: int = 2) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept)."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "embeddings")
    rows = ws.save(_nodes(vectors, id_col, vector_col), "rows")
    nodes = ws.save(rows.filter("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("raw").alias("raw")), "nodes")
    sizes = {r.dim: r.n for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    most = {dim: min(SAMPLE, SAMPLE_BYTES // (8 * dim) + 1) for dim in sizes}
    # The rows whose hash is below the share that the bound allows, in one pass for all lengths.
    bounds = spark.createDataFrame([(dim, int(min(1.0, most[dim] / n) * (1 << 31))) for dim, n in sizes.items()], "dim int, below long")
    kept = nodes.join(F.broadcast(bounds), "dim").filter(F.pmod(F.xxhash64("node"), F.lit(1 << 31)) < F.col("below"))
    samples: dict[int, list] = {}
    for r in kept.select("dim", "node", "raw").collect():
        samples.setdefault(r.dim, []).append((r.node, r.raw))
    for own in samples.values():
        own.sort()
    pivots = {dim: choose_pivots(_unit([raw for _, raw in samples.get(dim, [])]), pivot_count(n, len(samples[dim]))) for dim, n in sizes.items() if dim in samples}
    # A short table may have no row below the bound.
    for dim in sizes.keys() - pivots.keys():
        pivots[dim] = _unit([nodes.filter(F.col("dim") == dim).select("raw").first().raw])
    described = ws.save(_describe(nodes, pivots, nearest), "described")
    home = described.select("node", "dim", F.col("perm")[0].alias("pivot"))
    asks = described.select("node", "dim", F.explode("perm").alias("pivot"))
    # At most SAMPLE pivots for each length of vectors: how many blocks their lists need.
    lists = home.groupBy("dim", "pivot").agg(F.count("*").alias("h")).join(asks.groupBy("dim", "pivot").agg(F.count("*").alias("q")), ["dim", "pivot"])
    lists = ws.save(lists.select("dim", "pivot", F.ceil(F.col("h") / BLOCK).cast("int").alias("hb"), F.ceil(F.col("q") / BLOCK).cast("int").alias("qb")), "lists")
    lists = F.broadcast(lists)
    salt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["node", "copies", "raw", "perm", "dim", "pivot"]
    kept = described.withColumn("pivot", F.col("perm")[0]).join(lists, ["dim", "pivot"]).select(*cols, salt("hb").alias("x"), span("qb").alias("y"), F.lit(True).alias("home"))
    asked = described.withColumn("pivot", F.explode("perm")).join(lists, ["dim", "pivot"]).select(*cols, span("hb").alias("x"), salt("qb").alias("y"), F.lit(False).alias("home"))
    found = kept.union(asked).groupBy("dim", "pivot", "x", "y").applyInPandas(_compare(threshold, share), "node long, links long, other long")
    found = ws.save(found, "found")
    comps = ws.save(components(found.select(F.col("node").alias("a"), F.col("other").alias("b")), ws, "cc"), "comps")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "copies").join(counts, "node", "left").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # Each step is written, so that a large component's or node's rows may be split over tasks.
    named = ws.save(named.select("node", "copies", "links", "comp"), "named")
    member = ws.save(rows.select("vec_id", "node").filter("node is not null").join(named, "node"), "member")
    least = ws.save(member.groupBy("comp").agg(F.min("vec_id").alias("component_id")), "least")
    out = member.join(least, "comp").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = out.union(rows.filter("node is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
