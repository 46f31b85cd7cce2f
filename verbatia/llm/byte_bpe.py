"""Byte-level BPE by prefix dynamic programming: every byte prefix of a piece has one valid last token, which is stored.

A sequence of tokens is the encoding of its bytes exactly if each two neighbours are the encoding of theirs: merging always
takes the leftmost pair of least rank, so the first merge across a border of tokens would also happen if these two stood
alone. The encoding of a prefix of n bytes is therefore that of a shorter prefix and one token t behind it, for the one t
whose neighbour, the last token of the shorter prefix, bears it. ``last_tokens`` finds t for all bytes; following
it back from the end gives the ids. More bytes only lengthen the table (``Prefixes.append``), fewer cut it, and an edit leaves
what stands before it as it is and is followed only until pieces meet the old ones again (``edit_text``).

Two tokens x, y bear each other if no merge across their border happens while they are built. Tokens are built in
order of rank, so along x's last parts and y's first parts two parts face each other until the earlier of the two
wholes they become is built; a token of both that has a lower rank than that would take them (ties: the left merge is first).

Texts are cut at spaces and line feeds where white space stands alone, every distinct chunk is split by the pattern and encoded
once per task (``ChunkTable``), and ids are joined back by position; other texts are split as a whole. A piece that
is itself a token is that token. Substrings are looked up by 64-bit hashes; the ids of what was looked up are decoded and compared
with the bytes before they count.

Cases: a null or empty text has no ids and decodes to no bytes. Repeated rows are kept. Only the named columns
are read. Texts of any length pass whole; a piece of n bytes takes time and memory in proportion to n.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatia.llm.bytes_np import BYTE_VALUES, U, chunks, mix, prefix_sums, span_hash
from verbatia.llm.chunk_table import FEED, SPACE, ChunkTable, cut, join
from verbatia.llm.work import bound_batches, give_back

#: Bytes of text whose chunks are joined at once.
BLOCK_BYTES = 2 << 20
#: Prefixes of one length that are advanced one by one; more are advanced together.
FEW = 12
SHIFT = 32


class Vocabulary:
    """Byte strings by rank, the ways to put a token together from two, and which neighbours bear each other."""

    def __init__(self, tokens: dict[bytes, int]):
        self.rank = tokens
        self.longest = max(map(len, tokens))
        size = max(tokens.values()) + 1
        self.text: list[bytes] = [b""] * size
        for t, r in tokens.items():
            self.text[r] = t
        self.length = np.array([len(t) for t in self.text], np.int64)
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.at = np.cumsum(self.length) - self.length
        if any(bytes([b]) not in tokens for b in range(256)):
            raise ValueError("every byte must be a token")
        self.byte = np.array([tokens[bytes([b])] for b in range(256)], np.int64)
        made = sorted((x << SHIFT | y, z) for z, t in enumerate(self.text) for k in range(1, len(t)) if (x := tokens.get(t[:k])) is not None and (y := tokens.get(t[k:])) is not None)
        self.pairs, self.whole = (np.array(c, np.int64) for c in zip(*made)) if made else (np.zeros(0, np.int64),) * 2
        self.pair = dict(made)
        self._grow()
        hashes = mix(span_hash(prefix_sums(BYTE_VALUES[self.flat]), self.at, self.at + self.length))
        self.hashes = []
        for n in range(self.longest + 1):
            ids = np.flatnonzero((self.length == n) & self.reached)
            order = np.argsort(hashes[ids])
            self.hashes.append((hashes[ids][order], ids[order]))
        self.known: dict[int, bool] = {}

    def _grow(self) -> None:
        """Left and right part of each token as merging builds it; tokens that merging never builds are not ``reached``."""
        n = len(self.text)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.reached = np.ones(n, bool)
        for z, t in enumerate(self.text):
            if len(t) < 2:
                self.reached[z] = len(t) == 1
                continue
            parts = [self.rank[bytes([b])] for b in t]
            while len(parts) > 2:
                best = min(((self.pair.get(x << SHIFT | y, n), i) for i, (x, y) in enumerate(zip(parts, parts[1:]))))
                if best[0] == n:
                    break
                parts[best[1] : best[1] + 2] = [best[0]]
            self.reached[z] = len(parts) == 2 and self.pair.get(parts[0] << SHIFT | parts[1]) == z
            if self.reached[z]:
                self.left[z], self.right[z] = parts
                if any(len(self.text[p]) > 1 and p >= z for p in parts):
                    raise ValueError("a token must have a higher rank than the two that merging builds it from")
        #: When a token is built: single bytes before all others.
        self.born = np.where(self.length > 1, np.arange(n), -1)

    def bear(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether x and y, side by side, are the encoding of their bytes."""
        out = np.ones(len(x), bool)
        todo = np.arange(len(x))
        end_x = end_y = np.full(len(x), len(self.text) + 1, np.int64)
        while len(todo):
            key = x << SHIFT | y
            i = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1) if len(self.pairs) else np.zeros(len(key), np.int64)
            both = np.where(self.pairs[i] == key, self.whole[i], len(self.text) + 2) if len(self.pairs) else np.full(len(key), len(self.text) + 2)
            broken = (both < end_x) & (both <= end_y)
            out[todo[broken]] = False
            # The part that was built later is taken apart; of equal ones that on the right.
            from_x = self.born[x] > self.born[y]
            on = ~broken & (from_x | (self.born[y] >= 0))
            todo, x, y, end_x, end_y, from_x = (v[on] for v in (todo, x, y, end_x, end_y, from_x))
            x, y, end_x, end_y = np.where(from_x, self.right[x], x), np.where(from_x, y, self.left[y]), np.where(from_x, x, end_x), np.where(from_x, end_y, y)
        return out

    def bears(self, x: int, y: int) -> bool:
        key = x << SHIFT | y
        if (known := self.known.get(key)) is None:
            if len(self.known) > 1 << 18:
                self.known.clear()
            known = self.known[key] = bool(self.bear(np.array([x]), np.array([y]))[0])
        return known

    def matches(self, data: np.ndarray, depth: np.ndarray, low: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens that end at each byte from ``low`` on: (byte, length, token); depth is the length of the piece's prefix there."""
        sums = prefix_sums(BYTE_VALUES[data])
        at = np.arange(low, len(data))
        where, lengths, tokens = [at], [np.ones(len(at), np.int64)], [self.byte[data[low:]]]
        for n in range(2, min(self.longest, int(depth.max(initial=0))) + 1):
            at = at[depth[at] >= n]
            table, ids = self.hashes[n]
            if len(table):
                h = mix(span_hash(sums, at + 1 - n, at + 1))
                i = np.minimum(np.searchsorted(table, h), len(table) - 1)
                hit = table[i] == h
                where.append(at[hit])
                lengths.append(np.full(int(hit.sum()), n, np.int64))
                tokens.append(ids[i[hit]])
        return np.concatenate(where), np.concatenate(lengths), np.concatenate(tokens)

    def last_tokens(self, data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """For each byte the last token of the encoding of its piece up to it; ``known``: those of the first bytes, if there is one piece."""
        depth = np.arange(1, len(data) + 1) - np.repeat(offsets[:-1], np.diff(offsets))
        low = 0 if known is None else len(known)
        last = np.full(len(data), -1, np.int64)
        last[:low] = known if low else last[:low]
        where, length, token = self.matches(data, depth, low)
        order = np.argsort(depth[where], kind="stable")
        where, length, token = where[order], length[order], token[order]
        edge = np.flatnonzero(np.diff(depth[where], prepend=0)).tolist() + [len(where)]
        for a, b in zip(edge, edge[1:]):
            if b - a <= FEW:
                for i, n, t in zip(where[a:b].tolist(), length[a:b].tolist(), token[a:b].tolist()):
                    if n == depth[i] or self.bears(int(last[i - n]), t):
                        last[i] = t
                continue
            i, n, t = where[a:b], length[a:b], token[a:b]
            first = n == depth[i]
            last[i[first]] = t[first]
            i, n, t = i[~first], n[~first], t[~first]
            keys, back = np.unique(last[i - n] << SHIFT | t, return_inverse=True)
            good = self.bear(keys >> SHIFT, keys & ((1 << SHIFT) - 1))[back]
            last[i[good]] = t[good]
        return last

    def follow(self, last: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each piece, from its end back."""
        at, starts = offsets[1:] - 1, offsets[:-1]
        steps, owners = [], []
        live = np.flatnonzero(at >= starts)
        at = at[live]
        while len(live):
            t = last[at]
            steps.append(t)
            owners.append(live)
            at = at - self.length[t]
            on = at >= starts[live]
            live, at = live[on], at[on]
        if not steps:
            return [np.zeros(0, np.uint32)] * len(starts)
        token, owner = np.concatenate(steps)[::-1], np.concatenate(owners)[::-1]
        order = np.argsort(owner, kind="stable")
        return np.split(token[order].astype(np.uint32), np.cumsum(np.bincount(owner, minlength=len(starts)))[:-1])

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(pieces)
        open_ = []
        for i, p in enumerate(pieces):
            if (whole := self.rank.get(p)) is not None:
                out[i] = np.array([whole], np.uint32)
            elif p:
                open_.append(i)
        if open_:
            data = np.frombuffer(b"".join(pieces[i] for i in open_), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(pieces[i]) for i in open_])])
            coded = self.follow(self.last_tokens(data, offsets), offsets)
            if not np.array_equal(self.decode(np.concatenate(coded)), data):
                raise ValueError("two substrings share a hash")
            for i, ids in zip(open_, coded):
                out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids."""
        size = self.length[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.at[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class Prefixes:
    """A piece with the last token of each of its prefixes: it grows and shrinks at its end without being encoded anew."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", np.zeros(0, np.int64)
        self.append(piece)

    def append(self, more: bytes) -> Prefixes:
        if more:
            self.data += more
            data = np.frombuffer(self.data, np.uint8)
            self.last = self.vocabulary.last_tokens(data, np.array([0, len(data)]), self.last)
        return self

    def cut(self, n: int) -> Prefixes:
        """Keep the first n bytes."""
        self.data, self.last = self.data[:n], self.last[:n]
        return self

    def ids(self) -> np.ndarray:
        if (whole := self.vocabulary.rank.get(self.data)) is not None:
            return np.array([whole], np.uint32)
        return self.vocabulary.follow(self.last, np.array([0, len(self.data)]))[0]


class Coder:
    """Ids of whole texts: the pattern's matches, each encoded by itself."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.vocabulary = Vocabulary({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)})
        self.split = regex.compile(pattern).findall
        self.spans = regex.compile(pattern).finditer
        # Cutting is right if white space that stands alone parts matches: a space goes with what follows, a line feed stands alone.
        self.chunked = self.split("a b.c\nd,\n e") == ["a", " b", ".", "c", "\n", "d", ",", "\n", " e"] and self.split("\n") == ["\n"]
        self.pieces = ChunkTable(lambda p: [x.tobytes() for x in self.vocabulary.encode(p)], 200_000)
        self.table = ChunkTable(self._learn)

    def clear(self) -> None:
        self.pieces.clear()
        self.table.clear()

    def _learn(self, found: list[bytes]) -> list[bytes]:
        split = self.split("\n".join(c.decode() for c in found if c != b"\n"))
        coded = [p.encode() for p in split]
        ids = dict(zip(some := list(set(coded)), self.pieces.of(some)))
        out, own = [], []
        for p in coded:
            if p == b"\n":
                out.append(b"".join(own))
                own = []
            else:
                own.append(ids[p])
        out.append(b"".join(own))
        feed = self.pieces.of([b"\n"])[0]
        rest = iter(out)
        return [feed if c == b"\n" else next(rest) for c in found]

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text that is split as a whole."""
        coded = [p.encode() for p in self.split(text)]
        ids = dict(zip(some := list(set(coded)), self.pieces.of(some)))
        return np.frombuffer(b"".join(ids[p] for p in coded), np.uint32)

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Documents that are not cut: those with neighbouring, or other, white space."""
        space = (data == SPACE) | (data == FEED)
        bad = (data < 33) & ~space
        bad[1:] |= space[1:] & space[:-1]
        bad[1:] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        if len(data) > 2:
            a, b, c = data[:-2], data[1:-1], data[2:]
            high = (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
            bad[2:] |= high | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        out = np.zeros(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = True
        full = np.flatnonzero(np.diff(offsets) > 0)
        out[full] |= np.isin(data[offsets[full]], (SPACE, FEED)) | np.isin(data[offsets[full + 1] - 1], (SPACE, FEED))
        return out | (not self.chunked)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each document of a run."""
        sizes = np.diff(offsets)
        whole = self._whole(data, offsets) if len(data) else np.zeros(len(sizes), bool)
        if whole.any():
            own, sizes = data[np.repeat(~whole, sizes)], np.where(whole, 0, sizes)
            ends = np.concatenate([[0], np.cumsum(sizes)])
        else:
            own, ends = data, offsets
        ids, stops = join(self.table, own, *cut(own, ends))
        out = np.split(ids, stops[:-1])
        for d in np.flatnonzero(whole):
            out[d] = self.ids(data[offsets[d] : offsets[d + 1]].tobytes().decode())
        return out

    def edit_text(self, text: str, ids: np.ndarray, start: int, stop: int, put: str) -> tuple[str, np.ndarray]:
        """The text with its code points start to stop replaced, and its ids, of which only those near the edit are found anew."""
        start, stop = max(0, min(start, len(text))), max(start, min(stop, len(text)))
        new = text[:start] + put + text[stop:]
        shift = len(new) - len(text)
        # Matches look at most one character beyond their end, or, of white space, back to where it began.
        back = start
        while back and text[back - 1].isspace():
            back -= 1
        ends = np.cumsum(self.vocabulary.length[ids])
        starts = [m.start() for m in self.spans(text, max(0, back - 1 - len(text[:back].rpartition("\n")[2])))]
        begin = max((s for s in starts if s < back), default=0)
        old = {s for s in starts if s >= stop}
        fresh, resume = [], len(new)
        for m in self.spans(new, begin):
            if m.start() >= start + len(put) and m.start() - shift in old:
                resume = m.start()
                break
            fresh.append(m[0].encode())
        head = len(text[:begin].encode())
        tail = len(text[: resume - shift].encode())
        kept = ids[: int(np.searchsorted(ends, head, "right"))] if head else ids[:0]
        rest = ids[int(np.searchsorted(ends, tail, "right")) :] if tail else ids
        coded = self.vocabulary.encode(fresh)
        return new, np.concatenate([kept, *coded, rest]).astype(np.uint32)


@functools.lru_cache(2)
def _coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def _ids_array(found: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.int32)))


def encode_bytes(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids, decoded): all ids of the text, without special tokens, and the bytes that they decode to."""

    def run(batches):
        code = _coder(ranks, pattern)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text"), BLOCK_BYTES):
                found = code(data, offsets)
                ids = np.concatenate([*found, np.zeros(0, np.uint32)])
                size = np.array([code.vocabulary.length[x].sum() for x in found], np.int64)
                said = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), pa.py_buffer(code.vocabulary.decode(ids))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), _ids_array(found), said.cast(pa.binary())], ["doc_id", "ids", "decoded"])
        code.clear()
        give_back()

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def decode_bytes(coded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (doc_id, decoded): the bytes of each row's ids; null or no ids give none."""

    def run(batches):
        words = _coder(ranks, pattern).vocabulary
        for batch in batches:
            said = [words.decode(np.array(x.as_py() or [], np.int64)).tobytes() for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(said, pa.binary())], ["doc_id", "decoded"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def edit_texts(coded: DataFrame, edits: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Rows (doc_id, text, ids) of encoded texts (doc_id, text, ids) after their edits (doc_id, start, stop, put).

    Edits replace code points start to stop of the original text and must not overlap; an edit at the end appends. Texts
    without an edit keep their ids. Null ids or texts stay as they are; a null ``put`` deletes.
    """

    def run(batches):
        code = _coder(ranks, pattern)
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if r["text"] is not None and r["ids"] is not None:
                    text, ids = r["text"], np.array(r["ids"], np.uint32)
                    for e in sorted(r["edits"] or (), key=lambda e: (e["start"], e["stop"]), reverse=True):
                        text, ids = code.edit_text(text, ids, e["start"], e["stop"], e["put"] or "")
                    r["text"], r["ids"] = text, ids.tolist()
            yield pa.RecordBatch.from_pydict({c: [r[c] for r in rows] for c in ("doc_id", "text", "ids")}, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32()))]))
        code.clear()

    each = edits.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "put")).alias("edits"))
    bound_batches(coded.sparkSession)
    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "ids").join(each, "doc_id", "left").mapInArrow(run, "doc_id long, text string, ids array<int>")
