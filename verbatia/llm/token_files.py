"""Token-id output: one concatenated id array per file, document boundaries as Elias-Fano code.

File (little-endian): magic; documents, nulls among the ids, tokens, id width as 64-bit integers; the
smallest document id; the Elias-Fano code of the document ids less that one; the Elias-Fano code of
the documents' end offsets; the ids. An Elias-Fano code of n ascending numbers keeps the low bits of
each number packed and the high bits as a unary bit vector: about 2 + log2(largest / n) bits a number.
``select`` finds boundaries through a directory of one 32-bit count per 64 bits, made when opened; a reader
holds the codes and the ids of the documents it asks for, never a table of 64-bit offsets or the whole array.

Files are written below ``spark.checkpoint.dir`` in ascending order of document id: rows are dealt out
by ranges of the id, every task writes files of about ``FILE_TOKENS`` ids under names of its own attempt, and the rows of
the committed tasks are the manifest; files of lost attempts are never read.

Chunks that start with a space are tokenised independently of what precedes them, so each task
tokenises every distinct chunk once (``ChunkTable``) and joins the ids back by position; texts whose
white space or alphabet does not allow that are passed whole to the tokenizers library.

Cases: a null or empty text has the end id only. Null document ids come first. Rows with the same
document id stand in order of their text's hash. Only the named columns are read. An empty table
writes no file.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatia.llm.bytes_np import chunks
from verbatia.llm.chunk_table import FEED, SPACE, ChunkTable, cut, join
from verbatia.llm.work import Workspace, give_back

MAGIC = b"VBTOKEF1"
#: Bytes of text whose chunks are joined at once, and chunks of a task's table in each generation.
BLOCK_BYTES, TABLE_CHUNKS = 2 << 20, 300_000
#: Ids of a file before the next one is begun; a longer document has a file of its own.
FILE_TOKENS = 4 << 20
#: Chunks that the library gets as one text.
JOINED = 200
#: Documents whose boundaries are selected at once.
READ_DOCS = 2048


class EliasFano:
    """An ascending sequence of non-negative numbers."""

    def __init__(self, n: int, low_bits: int, high: np.ndarray, low: np.ndarray):
        self.n, self.low_bits, self.high, self.low = n, low_bits, high, low
        ones = np.bitwise_count(high.view("<u8")).astype(np.uint32)
        self.before = np.concatenate([[0], np.cumsum(ones, dtype=np.uint32)]).astype(np.uint32)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        bits = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
        place = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(((int(place[-1]) + 1 if n else 0) + 63) // 64 * 64, np.uint8)
        unary[place] = 1
        low = (v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        return cls(n, bits, np.packbits(unary, bitorder="little"), np.packbits(low.astype(np.uint8).ravel(), bitorder="little"))

    def select(self, i: np.ndarray) -> np.ndarray:
        """The numbers at the places i."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.before, i, "right") - 1
        bits = np.unpackbits(self.high.reshape(-1, 8)[word], axis=1, bitorder="little")
        one = (np.cumsum(bits, axis=1, dtype=np.uint8) > (i - self.before[word].astype(np.int64))[:, None]).argmax(axis=1)
        top = (64 * word + one - i).astype(np.uint64)
        at = i * self.low_bits
        own = at[:, None] + np.arange(self.low_bits)
        low = (self.low[own >> 3] >> (own & 7).astype(np.uint8) & 1).astype(np.uint64)
        return top << np.uint64(self.low_bits) | (low << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def dump(self) -> bytes:
        return np.array([self.n, self.low_bits, len(self.high), len(self.low)], "<i8").tobytes() + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def load(cls, source) -> EliasFano:
        """From the place of an open file."""
        n, bits, high, low = np.frombuffer(source.read(32), "<i8").tolist()
        return cls(n, bits, np.frombuffer(source.read(high), np.uint8), np.frombuffer(source.read(low), np.uint8))


def dump(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of documents in ascending order of their ids, nulls first."""
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    least = int(known[0]) if len(known) else 0
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    head = np.array([len(doc_ids), len(doc_ids) - len(known), len(ids), width, least], "<i8").tobytes()
    shifted = known.astype(np.uint64) - np.array(least, np.int64).astype(np.uint64)
    return MAGIC + head + EliasFano.of(shifted).dump() + EliasFano.of(np.cumsum(lengths)).dump() + ids.astype(f"<u{width}").tobytes()


class TokenFile:
    """A written file, open for reading: its codes; ids are read when asked for."""

    def __init__(self, source):
        self.source = source
        if bytes(source.read(8)) != MAGIC:
            raise ValueError("not a token file")
        self.documents, self.nulls, self.tokens, self.width, self.least = np.frombuffer(source.read(40), "<i8").tolist()
        self.doc_codes, self.ends = EliasFano.load(source), EliasFano.load(source)
        self.at = source.tell()

    def doc_ids(self, lo: int, hi: int) -> list[int | None]:
        known = self.doc_codes.select(np.arange(max(0, lo - self.nulls), max(0, hi - self.nulls)))
        return [None] * (min(hi, self.nulls) - min(lo, self.nulls)) + (known + np.array(self.least, np.int64).astype(np.uint64)).astype(np.int64).tolist()

    def bounds(self, lo: int, hi: int) -> np.ndarray:
        """Where documents lo to hi (exclusive) start, and where the last of them ends."""
        ends = self.ends.select(np.arange(max(0, lo - 1), hi)).astype(np.int64)
        return ends if lo else np.concatenate([[0], ends])

    def ids(self, start: int, end: int) -> np.ndarray:
        self.source.seek(self.at + start * self.width)
        return np.frombuffer(self.source.read((end - start) * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(*self.bounds(i, i + 1).tolist())


class Tokeniser:
    """Ids of texts, equal to the tokenizers library's."""

    def __init__(self, path: str):
        import tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.lib = tokenizers.Tokenizer.from_file(path)
        kind = str(self.lib.pre_tokenizer)
        special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        feed = self._ids("\n")
        self.feed = feed[0]
        self.chunked = (
            self.lib.normalizer is None
            and "ByteLevel" in kind
            and "add_prefix_space=False" in kind
            and "use_regex=True" in kind
            and len(feed) == 1
            and all(s.startswith("<|") for s in special)
        )
        self.table = ChunkTable(self._learn, TABLE_CHUNKS)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        """Chunks have white space at their start only; they are tokenised in one go with line feeds between."""
        got = {b"\n": np.array([self.feed], np.uint32).tobytes()}
        plain = [c for c in chunks if c != b"\n"]
        groups = [plain[at : at + JOINED] for at in range(0, len(plain), JOINED)]
        for some, coded in zip(groups, self.lib.encode_batch_fast([b"\n".join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(coded.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.feed).tolist()
            raw = ids.tobytes()
            got.update(zip(some, (raw[4 * a : 4 * b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)]))))
        return [got[c] for c in chunks]

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Documents that cannot be cut: neighbouring or other white space, control characters, special
        tokens, and alphabets beyond Latin, whose letters and digits need the library's own tables."""
        space = (data == SPACE) | (data == FEED)
        bad = ((data < 32) & ~space) | (data >= 0xC9)
        bad[1:] |= (space[1:] & space[:-1]) | ((data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))) | ((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        out = np.zeros(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = True
        return out | (not self.chunked)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each document of a run."""
        ids, ends = None, None
        whole = self._whole(data, offsets) if len(data) else np.zeros(len(offsets) - 1, bool)
        if whole.any():
            keep = np.repeat(~whole, np.diff(offsets))
            cut_data, sizes = data[keep], np.where(whole, 0, np.diff(offsets))
            cut_offsets = np.concatenate([[0], np.cumsum(sizes)])
        else:
            cut_data, cut_offsets = data, offsets
        ids, ends = join(self.table, cut_data, *cut(cut_data, cut_offsets))
        out = np.split(ids, ends[:-1])
        for d in np.flatnonzero(whole):
            out[d] = self._ids(data[offsets[d] : offsets[d + 1]].tobytes().decode())
        return out


@functools.lru_cache(2)
def _tokeniser(path: str) -> Tokeniser:
    return Tokeniser(path)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int | None, ws: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; returns their manifest (part, seq, path, documents, tokens, start: tokens before the file)."""
    root = f"{ws.root}/files"
    end = np.array([] if end_id is None else [end_id], np.uint32)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key").drop("text_key")

    def run(batches):
        encode = _tokeniser(tokenizer)
        part = TaskContext.get().partitionId()
        names, lengths, ids, held, seq = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal names, lengths, ids, held, seq
            raw = dump(names, np.array(lengths, np.int64), np.concatenate(ids))
            uri = f"{root}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.tok"
            fs, path = pyarrow.fs.FileSystem.from_uri(uri)
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(path) as f:
                f.write(raw)
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [uri], "documents": [len(names)], "tokens": [sum(lengths)]})
            names, lengths, ids, held, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            known = batch.column("doc_id").to_pylist()
            for lo, hi, data, offsets in chunks(batch.column("text"), BLOCK_BYTES):
                for name, x in zip(known[lo:hi], encode(data, offsets)):
                    names.append(name)
                    lengths.append(len(x) + len(end))
                    ids += (x, end)
                    held += len(x)
                if held >= FILE_TOKENS:
                    yield close()
        if names:
            yield close()
        encode.table.clear()
        give_back()

    files = ws.save(rows.mapInArrow(run, "part long, seq long, path string, documents long, tokens long"), "manifest")
    # One row for each task, then the files of each task: no window holds all files.
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tasks = files.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", before(W.orderBy("part")).alias("base"))
    return files.join(tasks, "part").withColumn("start", F.col("base") + before(W.partitionBy("part").orderBy("seq"))).drop("base")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, ids_le): every document of the files, its ids as little-endian 32-bit integers."""

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                fs, place = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_file(place) as source:
                    file = TokenFile(source)
                    lo = 0
                    while lo < file.documents:
                        bounds = file.bounds(lo, min(file.documents, lo + READ_DOCS))
                        hi = lo + max(1, int(np.searchsorted(bounds, bounds[0] + (1 << 20), "right")) - 1)
                        bounds = bounds[: hi - lo + 1]
                        raw = file.ids(int(bounds[0]), int(bounds[-1])).astype("<u4").tobytes()
                        at = (4 * (bounds - bounds[0])).tolist()
                        ids = [raw[a:b] for a, b in zip(at, at[1:])]
                        yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids(lo, hi), pa.int64()), pa.array(bounds[:-1] + start), pa.array(ids, pa.binary())], ["doc_id", "start", "ids_le"])
                        lo = hi

    spark = manifest.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(n, "path").mapInArrow(run, "doc_id long, start long, ids_le binary")


def token_digest(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"), F.crc32("ids_le").alias("ids_crc32"))
