"""Distinct-chunk table: texts are cut into chunks, each distinct chunk is tokenised once, and ids are joined back by position."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from verbatia.llm.bytes_np import BYTE_VALUES, U, mix, prefix_sums, span_hash

SPACE, FEED = 32, 10
#: Bytes of text whose chunks are joined at once.
BLOCK_BYTES = 1 << 20


class ChunkTable:
    """Values of chunks in two generations.

    When the young generation holds ``size`` chunks it becomes the old one, and chunks that are not met
    again by the next change are forgotten. Forgetting bounds memory and changes no result.
    """

    def __init__(self, learn: Callable[[list[bytes]], list[bytes]], size: int = 100_000):
        self.learn, self.size = learn, size
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def clear(self) -> None:
        """Forget all chunks: a worker that waits for other work holds none."""
        self.young, self.old = {}, {}

    def of(self, chunks: list[bytes]) -> list[bytes]:
        """The values of distinct chunks."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        lacking = [c for c in chunks if c not in young]
        new = []
        for c in lacking:
            if (v := old.get(c)) is None:
                new.append(c)
            else:
                young[c] = v
        if new:
            young.update(zip(new, self.learn(new)))
        return [young[c] for c in chunks]


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk starts and first chunks of documents: a chunk starts at a space, a line feed, after one, and with a text."""
    start = (data == SPACE) | (data == FEED)
    start[1:] |= data[:-1] == FEED
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(start)
    return at, np.searchsorted(at, offsets)


def join(table: ChunkTable, data: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks in order, and each document's end among them.

    Chunks of a block count as equal when their 64-bit hashes and lengths are; the table itself is keyed by bytes.
    """
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(first) - 1, np.int64)
    ends = np.append(starts[1:], len(data))
    h = mix(span_hash(prefix_sums(BYTE_VALUES[data]), starts, ends) + (ends - starts).astype(U))
    _, where, back = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    values = table.of([raw[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist())])
    flat = np.frombuffer(b"".join(values), np.uint32)
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    begin = np.cumsum(sizes) - sizes
    each = sizes[back]
    total = np.concatenate([[0], np.cumsum(each)])
    ids = flat[np.repeat(begin[back] - total[:-1], each) + np.arange(total[-1])]
    return ids, total[first[1:]]
