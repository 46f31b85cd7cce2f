"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the model has a whitespace marker after another character, merges never cross the
start of a run of markers, so a text is a sequence of chunks (markers, then other characters) that
are segmented one by one. Each task segments every distinct chunk it meets once, with the
sentencepiece library, and joins ids and decoded text back by position (``ChunkTable`` bounds the table). Characters of no piece
longer than one character never merge either; line feeds are split off for that reason. Models that break a condition (normalising models, whitespace suffixes, user-defined
pieces, pieces across markers) are handled by encoding whole texts with the library.

Cases: a null or empty text has no ids and decodes to the empty text. Repeated rows are kept.
Only the named columns are read. Texts of any length pass whole.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatia.llm.bytes_np import chunks
from verbatia.llm.chunk_table import BLOCK_BYTES, FEED, SPACE, ChunkTable, cut, join
from verbatia.llm.work import bound_batches, give_back

MARK = "▁"


class Segmenter:
    """Ids and decoded text of whole texts, equal to the library's."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        normal = [p for i, p in enumerate(pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        probe = " a  b ﬁ　\tc\n "
        self.chunked = (
            not any(re.search(f"[^{MARK}]{MARK}", p) for p in normal)
            and sp.normalize(probe) == (MARK + probe.replace(" ", MARK))
            and not self._defined(path, normal)
            and all(sp.is_byte(sp.piece_to_id(f"<0x{b:02X}>")) for b in range(256))
        )
        #: A chunk inside a text is segmented behind a line feed, which merges with nothing.
        self.chunked = self.chunked and not any("\n" in p and len(p) > 1 for p in normal)
        self.lead = sp.encode("\n")
        self.table = ChunkTable(self._learn)
        #: Chunks that are not decoded to themselves.
        self.changed: set[bytes] = set()

    def _defined(self, path: str, normal: list[str]) -> bool:
        """Whether user-defined pieces exist: they are matched before any merging."""
        with open(path, "rb") as f:
            raw = f.read()
        # ModelProto.pieces (field 1) holds SentencePiece messages; type (field 3) 4 is USER_DEFINED.
        at, n = 0, len(raw)
        while at < n and raw[at] == 0x0A:
            size, at, shift = 0, at + 1, 0
            while True:
                b = raw[at]
                at += 1
                size |= (b & 127) << shift
                shift += 7
                if b < 128:
                    break
            if raw[at : at + size].endswith(b"\x18\x04"):
                return True
            at += size
        return False

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        texts = ["\n" + c.decode() for c in chunks]
        ids = self.sp.encode(texts, num_threads=1)
        for c, text, said in zip(chunks, texts, self.sp.decode(ids, num_threads=1)):
            if text != said:
                self.changed.add(c)
        skip, flat = 4 * len(self.lead), np.fromiter(itertools.chain.from_iterable(ids), np.uint32).tobytes()
        ends = [0, *itertools.accumulate(4 * len(x) for x in ids)]
        return [flat[a + skip : b] for a, b in zip(ends, ends[1:])]

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Documents that are not cut: runs of spaces, white space at the start, markers and NUL in the text."""
        bad = data == 0
        bad[1:] |= (data[1:] == SPACE) & (data[:-1] == SPACE)
        bad[2:] |= (data[2:] == 0x81) & (data[1:-1] == 0x96) & (data[:-2] == 0xE2)
        out = np.zeros(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = True
        full = np.flatnonzero(np.diff(offsets) > 0)
        out[full] |= np.isin(data[offsets[full]], (SPACE, FEED))
        return out | (not self.chunked)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, str]]:
        """Ids and decoded text of each document of a run."""
        sizes = np.diff(offsets)
        odd = self._odd(data, offsets) if len(data) else np.zeros(len(sizes), bool)
        # Encoding puts a marker before a text, decoding takes it away: cut texts get their space here.
        parts, raw = [], data.tobytes()
        for d in np.flatnonzero(~odd & (sizes > 0)):
            parts += (b" ", raw[offsets[d] : offsets[d + 1]])
        marked = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.concatenate([[0], np.cumsum(np.where(odd | (sizes == 0), 0, sizes + 1))])
        ids, stops = join(self.table, marked, *cut(marked, ends))
        out = []
        for d, own in enumerate(np.split(ids, stops[:-1])):
            text = raw[offsets[d] : offsets[d + 1]]
            if odd[d]:
                own = np.array(self.sp.encode(text.decode()), np.uint32)
            same = not odd[d] and not (self.changed and any(c in text for c in self.changed))
            out.append((own, text.decode() if same else self.sp.decode(own.tolist())))
        return out


@functools.lru_cache(2)
def _segmenter(path: str) -> Segmenter:
    return Segmenter(path)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, ids, decoded) and the columns to keep: all ids of the text, without begin or end ids, and their decoded text."""

    def run(batches):
        segment = _segmenter(model)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text"), BLOCK_BYTES):
                coded = segment(data, offsets)
                ends = np.concatenate([[0], np.cumsum([len(ids) for ids, _ in coded])]).astype(np.int32)
                flat = pa.array(np.concatenate([ids for ids, _ in coded]).astype(np.int32))
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([said for _, said in coded], pa.string()), *(own.column(f"keep{i}") for i in range(len(keep)))],
                    ["doc_id", "ids", "decoded", *(f"keep{i}" for i in range(len(keep)))],
                )
        segment.table.clear()
        give_back()

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)))
    kept = "".join(f", keep{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string" + kept).withColumnsRenamed({f"keep{i}": c for i, c in enumerate(keep)})


def decode_pieces(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (doc_id, text): the library's decoding of each row's ids; null or no ids give the empty text."""

    def run(batches):
        sp = _segmenter(model).sp
        for batch in batches:
            said = [sp.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(said, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
