"""Ranked lexical search: the best documents of every item, by WAND over shards of documents, shard heaps merged.

A document's score for an item sums, over the item's terms, weight times impact; the impact grows with the term's
occurrences and falls with the document's length. All but the weights is integer arithmetic, so that results are equal everywhere.

First every document is turned into its length and its occurrences of the items' terms (one row, written); sums over these rows give
document frequencies, weights and lengths. Then every task reads its rows in shards of at most ``SHARD_POSTINGS`` postings. A shard
keeps, for each term, its documents in order, their impacts and the largest of these. An item's lists are then walked window by
window of documents: lists whose largest impacts together stay below the heap's threshold can't make a pivot and are not walked;
documents of the others are pivots if the largest impacts of all lists that hold them reach the threshold, and only pivots are
scored, with their own impacts, from the weightiest term on, as long as they still can reach it. The threshold is the score of
the item's k-th best document so far and goes on from shard to shard of a task. The tasks' heaps are merged by rank. A document
whose bound equals the threshold is scored too, so ties come out by id whatever the order of the shards.

Items are taken in blocks of at most ``BLOCK_TERMS`` of their terms, which is what a task holds at once beside a shard; every
block runs against all documents. Terms are compared by 64-bit hashes.

Cases: null or empty texts have no term, and neither do items without one: such an item has no row. Rows of one item id are
one item with all their terms. Repeated documents are ranked each by itself; equal scores stand in order of id (null first), then of
the text's hash. Only the named columns are read. Texts of any length pass whole. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatia.llm.bytes_np import ALNUM, U, Words, chunks
from verbatia.llm.work import Workspace, bound_batches, give_back

#: Terms of the items of a block (an item's distinct terms count each), and postings of a shard.
BLOCK_TERMS, SHARD_POSTINGS = 200_000, 2_000_000
#: Documents of a shard that a search looks at before its threshold is renewed.
WINDOW = 2048


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): each item's distinct terms, as hashes."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                w = Words(data, offsets, ALNUM)
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(lo, hi - lo).take(pa.array(w.doc)), pa.array(w.hash.view(np.int64))], ["item_id", "term"])

    rows = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    kind = items.schema[item_col].dataType.simpleString()
    return rows.mapInArrow(run, f"item_id {kind}, term long").distinct()


def _held(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(doc_id, text_key, length, places, counts): a document's length in terms and its occurrences of the given (sorted) ones."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        known = shared.value
        leading = np.zeros(1 << 20, bool)
        leading[known >> U(44)] = True
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                w = Words(data, offsets, ALNUM)
                at = np.flatnonzero(leading[w.hash >> U(44)])
                place = np.minimum(np.searchsorted(known, w.hash[at]), len(known) - 1)
                same = known[place] == w.hash[at]
                key, n = np.unique(w.doc[at[same]] * len(known) + place[same], return_counts=True)
                edge = np.searchsorted(key, np.arange(hi - lo + 1) * len(known))
                raw = [(key % len(known)).astype("<i4").tobytes(), n.astype("<i4").tobytes()]
                packed = [pa.array([x[4 * a : 4 * b] for a, b in zip(edge, edge[1:])], pa.binary()) for x in raw]
                own = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(w.count.astype(np.int64)), *packed], ["doc_id", "text_key", "length", "places", "counts"])
        give_back()

    return docs.mapInArrow(run, "doc_id long, text_key long, length long, places binary, counts binary")


def _frequencies(held: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each of the terms."""

    def run(batches):
        total = np.zeros(terms, np.int64)
        for batch in batches:
            for x in batch.column("places"):
                total[np.frombuffer(x.as_buffer(), "<i4")] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "n"])

    out = np.zeros(terms, np.int64)
    # BLOCK_TERMS rows at most.
    for r in held.select("places").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r.place] = r.n
    return out


class Shard:
    """Inverted lists of some documents: for each term its documents in order, their weighted impacts and the largest of these."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, documents: int):
        order = np.lexsort((doc, term))
        self.doc, self.impact = doc[order], impact[order]
        self.terms, first = np.unique(term[order], return_index=True)
        self.first = np.append(first, len(order))
        self.largest = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0, np.int64)
        self.documents = documents

    def search(self, terms: np.ndarray, heap: Heap) -> None:
        """Offer the heap every document that can be among its best."""
        at = np.searchsorted(self.terms, terms)
        at = at[at < len(self.terms)][self.terms[at[at < len(self.terms)]] == terms[at < len(self.terms)]]
        at = at[np.argsort(-self.largest[at], kind="stable")]
        if not len(at):
            return
        lists = [(self.doc[a:b], self.impact[a:b]) for a, b in zip(self.first[at], self.first[at + 1])]
        largest = self.largest[at]
        #: What the lists from each one on can add at most.
        rest = np.append(np.cumsum(largest[::-1])[::-1], 0)
        for low in range(0, self.documents, WINDOW):
            need = heap.threshold
            leading = int(np.searchsorted(-rest, -need, "right"))  # lists behind these reach no threshold together
            if not leading:
                return
            parts = [slice(*np.searchsorted(d, (low, low + WINDOW))) for d, _ in lists[:leading]]
            pivot = np.unique(np.concatenate([d[p] for (d, _), p in zip(lists, parts)]))
            # Pivots: the largest impacts of the lists that hold a document reach the threshold.
            pivot = self._pass(pivot, lists, largest, rest, need, True)[0]
            pivot, score = self._pass(pivot, lists, largest, rest, need, False)
            good = score >= need
            heap.offer(score[good], pivot[good])

    @staticmethod
    def _pass(docs: np.ndarray, lists: list, largest: np.ndarray, rest: np.ndarray, need: int, bound: bool) -> tuple[np.ndarray, np.ndarray]:
        """Documents whose sum over the lists (of largest or of own impacts) reaches ``need``, and the sums."""
        total = np.zeros(len(docs), np.int64)
        for i, (doc, impact) in enumerate(lists):
            able = total + rest[i] >= need
            if not able.all():
                docs, total = docs[able], total[able]
            if not len(docs):
                break
            k = np.minimum(np.searchsorted(doc, docs), len(doc) - 1)
            total = total + np.where(doc[k] == docs, largest[i] if bound else impact[k], 0)
        able = total >= need
        return docs[able], total[able]


class Heap:
    """The k best (score, document), and the score that a further one must reach."""

    def __init__(self, k: int):
        self.k, self.threshold = k, 1
        self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.names: list[tuple] = []

    def offer(self, score: np.ndarray, doc: np.ndarray) -> None:
        """Documents of the present shard, by number."""
        if len(score):
            self.score, self.doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
            if len(self.score) > 4 * self.k or self.threshold == 1:
                self._cut()

    def _cut(self) -> None:
        if len(self.score) >= self.k:
            self.threshold = max(1, int(np.partition(self.score, -self.k)[-self.k]))
            keep = self.score >= self.threshold
            self.score, self.doc = self.score[keep], self.doc[keep]

    def close(self, names: list[tuple]) -> None:
        """End of a shard: its documents get their names (id, text key); the k best of all shards stay."""
        self._cut()
        fresh = [(-int(s), *names[d]) for s, d in zip(self.score, self.doc)]
        self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if fresh:
            self.names = sorted(self.names + fresh, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2]))[: self.k]
        if len(self.names) == self.k:
            self.threshold = max(self.threshold, -self.names[-1][0])


def _search(held: DataFrame, items: list[tuple[int, np.ndarray]], weight: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, text_key, score): for every task the k best documents of each item, given by number with its terms' places."""
    shared = held.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches):
        items, weight = shared.value
        heaps = [Heap(k) for _ in items]
        names: list[tuple] = []
        lengths, sizes, places, counts = [], [], [], []
        size = 0

        def close() -> None:
            nonlocal names, lengths, sizes, places, counts, size
            term, tf = np.frombuffer(b"".join(places), "<i4").astype(np.int64), np.frombuffer(b"".join(counts), "<i4").astype(np.int64)
            doc = np.repeat(np.arange(len(names)), sizes)
            m = 50 + 50 * np.array(lengths, np.int64) * documents // total
            shard = Shard(term, doc, weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc])), len(names))
            for (_, own), heap in zip(items, heaps):
                shard.search(own, heap)
                heap.close(names)
            names, lengths, sizes, places, counts, size = [], [], [], [], [], 0

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "length", "places", "counts"))):
                names.append(row[:2])
                lengths.append(row[2])
                sizes.append(len(row[3]) // 4)
                places.append(row[3])
                counts.append(row[4])
                size += sizes[-1]
                if size >= SHARD_POSTINGS:
                    close()
        if names:
            close()
        best = [(item, d, key, -s) for (item, _), heap in zip(items, heaps) for s, d, key in heap.names]
        for at in range(0, len(best), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*best[at : at + 10_000])], ["item", "doc_id", "text_key", "score"])
        give_back()

    return held.filter("octet_length(places) > 0").mapInArrow(run, "item long, doc_id long, text_key long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (item_id, rank, doc_id, text_key, score): the k documents of highest score of every item, all with a score above 0."""
    spark = docs.sparkSession
    bound_batches(spark)
    ws = Workspace(spark, "search")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    asked = ws.save(item_terms(items, item_col, item_text_col), "items")
    # Items are dealt into blocks by hash; a block is what one pass over the documents answers.
    blocks = max(1, math.ceil(asked.count() / BLOCK_TERMS))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(blocks)).cast("int"))
    found = [_block(ws, docs, numbered.filter(F.col("block") == b).drop("block"), k, b) for b in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _block(ws: Workspace, docs: DataFrame, asked: DataFrame, k: int, number: int) -> DataFrame:
    spark = docs.sparkSession
    pairs = asked.toArrow()  # about BLOCK_TERMS rows
    named = pairs.column("item_id").to_pylist()
    hashes = pairs.column("term").to_numpy().astype(np.int64).view(U)
    terms = np.unique(hashes) if len(hashes) else np.zeros(1, U)
    own: dict = {}
    for name, place in zip(named, np.searchsorted(terms, hashes).tolist()):
        own.setdefault(name, []).append(place)
    names, groups = list(own), [(i, np.array(sorted(places), np.int64)) for i, places in enumerate(own.values())]
    held = ws.save(_held(docs, terms), f"held-{number}")
    documents, total = held.filter("length > 0").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    df = _frequencies(held, len(terms))
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    best = _search(held, groups, weight, documents, max(1, total), k)
    rank = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "text_key")
    best = ws.save(best.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k), f"best-{number}")
    ws.drop(f"held-{number}")
    numbers = spark.createDataFrame(pa.table({"item": pa.array(range(len(names)), pa.int64()), "item_id": pa.array(names, pairs.schema.field("item_id").type)}))
    return best.join(F.broadcast(numbers), "item").select("item_id", "rank", "doc_id", "text_key", "score")
