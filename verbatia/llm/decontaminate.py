"""Benchmark decontamination: a prefix-filtered set join of documents with item windows.

A window is ``size`` consecutive words of an item; an item of fewer words, but not none, is one window.
Windows contain shingles of up to ``GRAM`` words. Shingles are ordered by their number of occurrences in
all documents, rarest first; containment of a whole window makes its rarest shingle the only prefix
token that must be joined. A joined position gives the window's place in the document (positional bound),
which must lie within the document's words (length bound); then the window is verified exactly, by
hash and word by word. Words: A-Z lower-cased, runs of ASCII letters, digits and non-ASCII characters.

Cases: a null or empty text has no words, no hits and no items. Repeated rows are separate documents.
Items that are null or without words have no window; repeated item ids count once. An empty table of
items hits nothing. Only the named id and text columns are read, so other columns may have any name.

Items of at most ``BLOCK_BYTES`` of text in all are one broadcast index of bounded size. Beyond that the same join is one of
tables: the items' shingles and windows, the documents' counts of those shingles, each window's rarest shingle, the documents'
positions of these, and the candidates of each text verified word by word; nothing but the size reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatia.llm.bytes_np import ALNUM, Words, chunks, mix, prefix_sums, span_hash, U
from verbatia.llm.work import Workspace, bound_batches, give_back

GRAM = 3
BLOCK_BYTES = 8 << 20
HITS = "doc_id long, text_key long, n_words long, hits array<struct<s:int,e:int>>, items array<string>"


def _gram(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position."""
    n = max(0, len(h) - k + 1)
    acc = h[:n].copy()
    for j in range(1, k):
        acc = mix(acc * U(0x8CB92BA72F3D8DD7) + h[j : j + n])
    return acc


class _Lookup:
    """Positions of hashes in a sorted table, by a bitmap of leading bits first."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[keys >> U(44)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which positions of h are in the table, and where in it."""
        at = np.flatnonzero(self.bits[h >> U(44)])
        k = np.searchsorted(self.keys, h[at])
        k[k == len(self.keys)] = 0
        same = self.keys[k] == h[at]
        return at[same], k[same]


def _item_words(text: str) -> tuple[Words, list[bytes]]:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    w = Words(data, np.array([0, len(data)]), ALNUM)
    return w, [bytes(w.low[s:e]) for s, e in zip(w.start, w.end)]


def _count_grams(docs: DataFrame, grams: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Occurrences in all documents of each shingle in question, by length."""
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def count(batches):
        found = {k: np.zeros(len(v), np.int64) for k, v in shared.value.items()}
        look = {k: _Lookup(v) for k, v in shared.value.items()}
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                w = Words(data, offsets, ALNUM)
                for k, f in look.items():
                    _, where = f(_gram(w.hash, k))
                    found[k] += np.bincount(where, minlength=len(found[k]))
        for k, v in found.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(v[at])], ["k", "i", "n"])

    out = {k: np.zeros(len(v), np.int64) for k, v in grams.items()}
    for k, i, n in docs.select("text").mapInArrow(count, "k int, i long, n long").groupBy("k", "i").agg(F.sum("n")).collect():
        out[k][i] = n
    return out


def _index(docs: DataFrame, items: list[tuple[str, str]], size: int):
    """Windows by the hash of their rarest shingle."""
    words = [(name, *_item_words(text)) for name, text in items if text]
    words = [x for x in words if x[2]]
    grams: dict[int, list] = {}
    for _, w, spelled in words:
        k = min(GRAM, size, len(spelled))
        grams.setdefault(k, []).append(_gram(w.hash, k))
    tables = {k: np.unique(np.concatenate(v)) for k, v in grams.items()}
    counts = _count_grams(docs, tables) if tables else {}
    rows, spelling = [], []
    for i, (name, w, spelled) in enumerate(words):
        span = min(size, len(spelled))
        k = min(GRAM, span)
        h = _gram(w.hash, k)
        n = counts[k][np.searchsorted(tables[k], h)]
        sums = prefix_sums(w.hash)
        spelling.append((name, spelled))
        for s in range(len(spelled) - span + 1):
            near = slice(s, s + span - k + 1)
            o = min(range(span - k + 1), key=lambda j: (n[near][j], h[near][j]))
            rows.append((k, h[s + o], o, span, span_hash(sums, np.array([s]), np.array([s + span]))[0], i, s))
    index = {}
    for k in tables:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        cols = [np.array([r[c] for r in own], dtype=t) for c, t in ((1, U), (2, np.int64), (3, np.int64), (4, U), (5, np.int64), (6, np.int64))]
        keys, start, many = np.unique(cols[0], return_index=True, return_counts=True)
        index[k] = (keys, start, many, *cols[1:])
    return index, spelling


def _same(w: Words, s: int, n: int, words: list[bytes], at: int) -> bool:
    return all(bytes(w.low[w.start[s + j] : w.end[s + j]]) == words[at + j] for j in range(n))


def _windows(w: Words, k: int, index: tuple, look: _Lookup, spelling) -> tuple[np.ndarray, ...]:
    """Verified windows of the documents: first word, number of words, item."""
    keys, start, many, off, span, code, item, place = index
    pos, key = look(_gram(w.hash, k))
    each = many[key]
    row = np.repeat(start[key], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    pos = np.repeat(pos, each)
    doc, s = w.doc[pos], pos - off[row]
    fits = (s >= w.first[doc]) & (s + span[row] <= w.first[doc + 1])
    s, row = s[fits], row[fits]
    same = span_hash(prefix_sums(w.hash), s, s + span[row]) == code[row]
    s, row = s[same], row[same]
    order = np.lexsort((s, place[row] - s, item[row]))
    s, row = s[order], row[order]
    good = np.ones(len(s), dtype=bool)
    a = 0
    while a < len(s):  # runs of neighbouring windows of one item are compared once
        b = a + 1
        while b < len(s) and item[row[b]] == item[row[a]] and s[b] - s[b - 1] == place[row[b]] - place[row[b - 1]] == 1:
            b += 1
        if not _same(w, s[a], s[b - 1] + span[row[b - 1]] - s[a], spelling[item[row[a]]][1], place[row[a]]):
            good[a:b] = [_same(w, s[i], span[row[i]], spelling[item[row[i]]][1], place[row[i]]) for i in range(a, b)]
        a = b
    return s[good], span[row[good]], item[row[good]]


def _match(docs: DataFrame, index, spelling) -> DataFrame:
    """Hit word ranges and items of each document, for one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast((index, spelling))

    def run(batches):
        index, spelling = shared.value
        look = {k: _Lookup(v[0]) for k, v in index.items()}
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offsets in chunks(batch.column("text")):
                w = Words(data, offsets, ALNUM)
                found = [_windows(w, k, index[k], look[k], spelling) for k in index]
                hits, items = [[] for _ in range(hi - lo)], [set() for _ in range(hi - lo)]
                if any(len(f[0]) for f in found):
                    s, n, item = (np.concatenate([f[c] for f in found]) for c in range(3))
                    edge = np.zeros(len(w.hash) + 1, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + n, -1)
                    hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
                    for a, b in zip(np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])):
                        while a < b:  # a run may touch the next document's run
                            d = w.doc[a]
                            e = min(b, w.first[d + 1])
                            hits[d].append({"s": int(a - w.first[d]), "e": int(e - w.first[d])})
                            a = e
                    for d, i in {*zip(w.doc[s].tolist(), item.tolist())}:
                        items[d].add(spelling[i][0])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), batch.column("text_key").slice(lo, hi - lo), pa.array(w.count.astype(np.int64)), pa.array(hits, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    ["doc_id", "text_key", "n_words", "hits", "items"],
                )
        give_back()

    return docs.mapInArrow(run, HITS)


def _windows_of(items: DataFrame, size: int) -> DataFrame:
    """(item, k, span, grams, words): every window of the items, the hashes of its shingles and its words."""

    def run(batches):
        for batch in batches:
            for name, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                w, spelled = _item_words(text)
                span = min(size, len(spelled))
                k = min(GRAM, span)
                h = _gram(w.hash, k).view(np.int64).tolist() if spelled else []
                starts = range(len(spelled) - span + 1) if spelled else ()
                n = len(starts)
                rows = {"item": [name] * n, "k": [k] * n, "span": [span] * n, "grams": [h[s : s + span - k + 1] for s in starts], "words": [b" ".join(spelled[s : s + span]).decode() for s in starts]}
                yield pa.RecordBatch.from_pydict(rows, pa.schema([("item", pa.string()), ("k", pa.int32()), ("span", pa.int32()), ("grams", pa.list_(pa.int64())), ("words", pa.string())]))

    return items.mapInArrow(run, "item string, k int, span int, grams array<long>, words string")


def _positions(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(text_key, k, gram, pos): every shingle of the documents."""

    def run(batches):
        for batch in batches:
            for lo, _, data, offsets in chunks(batch.column("text")):
                w = Words(data, offsets, ALNUM)
                keys = batch.column("text_key")
                for k in lengths:
                    n = max(0, len(w.hash) - k + 1)
                    inside = w.doc[:n] == w.doc[k - 1 :][:n]
                    at = np.flatnonzero(inside)
                    doc = w.doc[at]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(lo + doc)), pa.array(np.full(len(at), k, np.int32)), pa.array(_gram(w.hash, k)[at].view(np.int64)), pa.array(at - w.first[doc])], ["text_key", "k", "gram", "pos"])
        give_back()

    return docs.select("text_key", "text").mapInArrow(run, "text_key long, k int, gram long, pos long")


def _verified(rows: DataFrame) -> DataFrame:
    """Hits of documents with candidates (s, span, words): the candidates whose words stand there."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                w = Words(data, offsets, ALNUM)
                hits, found = [], []
                for d, cands in enumerate(batch.column("cands").slice(lo, hi - lo).to_pylist()):
                    own, first, last = [], w.first[d], w.first[d + 1]
                    for c in cands or ():
                        a, b = first + c["s"], first + c["s"] + c["span"]
                        if first <= a and b <= last and b" ".join(bytes(w.low[x:y]) for x, y in zip(w.start[a:b], w.end[a:b])).decode() == c["words"]:
                            own.append((c["s"], c["s"] + c["span"], c["words"]))
                    ranges: list[dict] = []
                    for s, e, _ in sorted(own):
                        if ranges and s <= ranges[-1]["e"]:
                            ranges[-1]["e"] = max(e, ranges[-1]["e"])
                        else:
                            ranges.append({"s": s, "e": e})
                    hits.append(ranges)
                    found.append(sorted({x for *_, x in own}))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("text_key").slice(lo, hi - lo), pa.array(w.count.astype(np.int64)), pa.array(hits, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(found, pa.list_(pa.string()))],
                    ["doc_id", "text_key", "n_words", "hits", "windows"],
                )
        give_back()

    return rows.mapInArrow(run, "doc_id long, text_key long, n_words long, hits array<struct<s:int,e:int>>, windows array<string>")


def _by_tables(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """The join for items beyond one block."""
    ws = Workspace(docs.sparkSession, "decontaminate")
    every = ws.save(_windows_of(items, size), "windows")
    lengths = [r.k for r in every.select("k").distinct().collect()]  # GRAM of them at most
    windows = every.select("k", "span", "grams", "words").dropDuplicates(["words", "span"])
    shingles = ws.save(windows.select("k", F.explode("grams").alias("gram")).distinct(), "shingles")
    positions = _positions(docs, lengths)
    # Written before they are joined, so that the rows of one shingle may be split over tasks.
    counts = ws.save(positions.groupBy("k", "gram").agg(F.count("*").alias("n")).join(shingles, ["k", "gram"], "left_semi"), "counts")
    each = windows.select("k", "span", "words", F.posexplode("grams").alias("o", "gram")).join(counts, ["k", "gram"], "left")
    # A window with a shingle that no document has occurs nowhere.
    rarest = each.groupBy("words", "span", "k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "o")).alias("r")).filter("r.n > 0")
    index = ws.save(rarest.select("k", F.col("r.gram").alias("gram"), F.col("r.o").alias("o"), "span", "words"), "index")
    met = positions.join(index, ["k", "gram"]).select("text_key", (F.col("pos") - F.col("o")).cast("int").alias("s"), "span", "words").filter("s >= 0").distinct()
    cands = ws.save(met.groupBy("text_key").agg(F.collect_list(F.struct("s", "span", "words")).alias("cands")), "candidates")
    found = ws.save(_verified(docs.join(cands, "text_key", "left").select("doc_id", "text_key", "text", "cands")), "found")
    named = found.select("text_key", F.explode("windows").alias("words")).distinct().join(every.select("words", "item").distinct(), "words")
    named = named.groupBy("text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.expr("cast(array() as array<string>)")
    return found.drop("windows").join(named, "text_key", "left").select("doc_id", "text_key", "n_words", "hits", F.coalesce("items", none).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 13) -> DataFrame:
    """Rows (doc_id, text_key, n_words, hits, items): text_key is xxhash64 of the text; hit word ranges and the sorted ids of occurring items, per document."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).filter("item is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > BLOCK_BYTES:
        return _by_tables(docs, items, size)
    return _match(docs, *_index(docs, [tuple(r) for r in items.collect()], size))


def hit_words() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])


def contaminated() -> Column:
    """Some hit, and at least a twentieth of the words."""
    return (hit_words() > 0) & (20 * hit_words() >= F.col("n_words"))


def contamination(found: DataFrame) -> DataFrame:
    """Counts and the verdict."""
    return found.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
