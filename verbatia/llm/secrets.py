"""Secret scan with a recursive decoding worklist.

The text is scanned for secrets; then its percent escapes, character escapes (backslash u, U, x and
character references), base64 runs, those wrapped over lines too, runs of hexadecimal digits, and compressed payloads (gzip, zlib, zstd, bzip2, xz inside these)
are unwrapped; zero bytes of wider encodings are left out. Each result is a layer that is scanned and unwrapped in turn until no new layer appears. A
layer equal to one already seen for the same place is not entered again, so that self-reproducing
payloads end. Every layer keeps, for each character, the range of the original text it comes from; a
secret of a layer is reported with the original range of its characters (of the whole payload, where
it was compressed). Offsets are code points, ends exclusive.

Kinds: assign (a key word, ``:`` or ``=``, a value of 12 characters or more), access (``AKIA`` and
capitals or digits, 18 or more in all), hex (16 lower-case hexadecimal digits or more). Matches are
leftmost and do not overlap within a kind; matches that are too short are dropped but still consumed.

Every base64 run is decoded, whatever its bytes are (one character for each byte, as all patterns are ASCII),
and also behind the characters that may join payloads (``-``, ``_``, ``/``, ``+``). All members of a
compressed payload are unfolded, wherever it begins inside the run's bytes. One that unfolds to more than
``INFLATE_LIMIT`` bytes is unwrapped in pieces of about that size, cut only where no pattern can match, so
that they give what the whole would; a stretch without such a place stays whole, however long.

Cases: a null or empty text has no spans. Repeated rows are scanned separately. Texts of any length
pass whole. Only the named columns are read.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatia.llm.work import bound_batches, give_back

KINDS = ("assign", "access", "hex")
# Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

WORDS = ("passw", "secret", "token", "key")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|amp|lt|gt|apos);")
NAMED = {"&quot;": '"', "&amp;": "&", "&lt;": "<", "&gt;": ">", "&apos;": "'"}
#: A line end, written out or escaped, that a payload is wrapped at; the joined run is decoded, but not scanned as such.
WRAP = re.compile(r"(?<=[A-Za-z0-9+/_-]{16})(?:\r?\n|(?:\\r)?\\n)[ \t]*(?=[A-Za-z0-9+/_=-])")
ZERO = re.compile("\0+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
JOINT = re.compile(r"[+/]")
#: Hexadecimal digits of 16 bytes or more; fewer bytes hold no secret and no payload.
DIGITS = re.compile(r"[0-9A-Fa-f]{32,}")
#: First bytes of gzip, zlib, bzip2 and xz members and of zstd frames, which may be skippable ones.
MEMBER = re.compile(rb"BZh[1-9]1AY&SY|\xfd7zXZ\0|\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|\x28\xb5\x2f\xfd|[\x50-\x5f]\x2a\x4d\x18")
#: Turns bytes that occur in no pattern above into line ends, and the others into spaces.
APART = bytes(32 if chr(i).isalnum() and i < 128 or chr(i) in "+/_.=-\"' :%\\&#;{}" else 10 for i in range(256))
INFLATE_LIMIT = 8 << 20
SCHEMA = "array<struct<kind:string,start:int,end:int,depth:int>>"


def scan(text: str) -> list[tuple[str, int, int]]:
    """Secrets of one layer: (kind, start, end) by start, then kind."""
    found = []
    low = text.lower() if not text.islower() else text
    if any(w in low for w in WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


class Layer:
    """A text, and where a range of it lies in the layer it was made of; no such layer: the original itself."""

    __slots__ = ("text", "parent", "place", "depth")

    def __init__(self, text: str, parent: Layer | None = None, place=None):
        self.text, self.parent, self.place = text, parent, place
        self.depth = 0 if parent is None else parent.depth + 1

    def origin(self, s: int, e: int) -> tuple[int, int]:
        layer = self
        while layer.parent is not None:
            s, e = layer.place(s, e)
            layer = layer.parent
        return s, e


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with all matches decoded; ``decode`` gives (text, offsets of its characters' sources)."""
    # Pieces of the new text: their first character, and the range they come from.
    parts, firsts, starts, ends, at, size = [], array("q"), array("q"), array("q"), 0, 0

    def put(text: str, a: int, b: int) -> None:
        nonlocal size
        if text:
            parts.append(text)
            firsts.append(size)
            starts.append(a)
            ends.append(b)
            size += len(text)

    for m in pattern.finditer(layer.text):
        got = decode(m.group())
        if got is None:
            continue
        put(layer.text[at : m.start()], at, m.start())
        for c, a, b in got:
            put(c, m.start() + a, m.start() + b)
        at = m.end()
    if not at:
        return None
    put(layer.text[at:], at, len(layer.text))
    firsts.append(size)

    def place(s: int, e: int) -> tuple[int, int]:
        i, j = bisect_right(firsts, s) - 1, bisect_right(firsts, e - 1) - 1
        # A decoded character has one position; a kept piece has as many as its source.
        return starts[i] + s - firsts[i], ends[j] if e == firsts[j + 1] else starts[j] + e - firsts[j]

    return Layer("".join(parts), layer, place)


def _characters(raw: bytes, step: float, size: int) -> list[tuple[str, int, int]] | None:
    """UTF-8 characters with the source range of their bytes; ``step`` source characters make a byte."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        out.append((c, int(at * step), min(size, -int(-(at + n) * step // 1))))
        at += n
    return out


def _percent(s: str):
    raw = bytes.fromhex(s.replace("%", ""))
    return _characters(raw, 3, len(s)) or [(chr(b), 3 * i, 3 * i + 3) for i, b in enumerate(raw)]


def _escape(s: str):
    if s in NAMED:
        return [(NAMED[s], 0, len(s))]
    digits = s.strip("\\&#;{}uUxX")
    code = int(digits, 10 if s[:2] == "&#" and s[2] not in "xX" else 16)
    return [(chr(code), 0, len(s))] if 0 < code < 0xD800 or 0xDFFF < code < 0x110000 else None


def _frame_end(raw: bytes, at: int) -> int:
    """The end of the zstd frame at a place, by the sizes of its blocks."""
    import zstandard

    if raw[at] != 0x28:
        return at + 8 + int.from_bytes(raw[at + 4 : at + 8], "little")
    head = raw[at : at + 18]
    sums = 4 * zstandard.get_frame_parameters(head).has_checksum
    at += zstandard.frame_header_size(head)
    block = 0
    while not block & 1 and at < len(raw):
        block = int.from_bytes(raw[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
    return at + sums


def _inflate(raw: bytes, at: int) -> Iterator[tuple[bytes, int]]:
    """Unfolded bytes of the compressed members at a place, in pieces, and how far the members read so far reach.

    A damaged member gives what lies before the damage, and then reaches -1.
    """
    try:
        while m := MEMBER.match(raw, at):
            if m.group()[:1] in b"\x1f\x78":
                # A step of 8 KB unfolds to some 8 MB at most.
                machine, step = zlib.decompressobj(47), 1 << 13
                while not machine.eof and at < len(raw):
                    before = machine.copy()
                    try:
                        piece = machine.decompress(raw[at : at + step])
                    except zlib.error:
                        if step == 1:
                            raise
                        # What precedes the damage is read in smaller steps.
                        machine, step = before, max(1, step >> 4)
                        continue
                    at = min(len(raw), at + step)
                    yield piece, len(raw)
                at -= len(machine.unused_data)
            elif m.group()[:1] in b"B\xfd":
                machine, more = bz2.BZ2Decompressor() if m.group()[:1] == b"B" else lzma.LZMADecompressor(), raw[at:]
                while not machine.eof and (more or not machine.needs_input):
                    piece, more = machine.decompress(more, 1 << 20), b""
                    yield piece, len(raw)
                at = len(raw) - len(machine.unused_data)
            else:
                end = min(len(raw), _frame_end(raw, at))
                if raw[at] == 0x28:
                    import zstandard

                    with zstandard.ZstdDecompressor().stream_reader(raw[at:end]) as f:
                        while piece := f.read(1 << 17):
                            yield piece, len(raw)
                at = end
            yield b"", at
            while raw[at : at + 1] == b"\0":
                at += 1
    except Exception as e:  # noqa: BLE001 - damaged payloads end where they break
        if not isinstance(e, (zlib.error, lzma.LZMAError, OSError, EOFError)) and type(e).__name__ != "ZstdError":
            raise
        yield b"", -1


def _texts(pieces: Iterator[tuple[bytes, int]]) -> Iterator[str]:
    """The same bytes as texts of about ``INFLATE_LIMIT`` or more, cut behind bytes that no pattern can hold."""
    held, size, cut = [], 0, 0
    for piece, _ in pieces:
        if at := piece.translate(APART).rfind(b"\n") + 1:
            cut = size + at
        held.append(piece)
        size += len(piece)
        if size >= INFLATE_LIMIT and cut:
            whole = b"".join(held)
            yield whole[:cut].decode("latin-1")
            held, size, cut = [whole[cut:]], size - cut, 0
    if size:
        yield b"".join(held).decode("latin-1")


def _payloads(layer: Layer) -> Iterator[Layer]:
    """Layers inside base64 runs.

    A payload may begin with the run or behind any character that joins payloads, so the run is decoded from
    its first such place of each remainder by 4; later payloads of the same remainder are then decoded too.
    The joining character makes a byte on either side that no pattern holds.
    """
    for m in BASE64.finditer(layer.text):
        run = m.group()
        body = run.rstrip("=").translate({ord("-"): "+", ord("_"): "/"})
        begins = {0: 0}
        for p in JOINT.finditer(body):
            begins.setdefault(p.end() % 4, p.end())
            if len(begins) == 4:
                break
        for begin in begins.values():
            some = body[begin : len(body) - ((len(body) - begin) % 4 == 1)]
            raw = base64.b64decode(some + "=" * (-len(some) % 4))
            if not raw:
                continue
            start, size, n = m.start() + begin, len(run) - begin, len(raw)

            def place(s: int, e: int, start=start, size=size, n=n) -> tuple[int, int]:
                return start + s * 4 // 3, start + (size if e == n else -(-e * 4 // 3))

            yield from _unfolded(raw, layer, place)


def _digits(layer: Layer) -> Iterator[Layer]:
    """Layers inside runs of hexadecimal digits, two a byte; of an odd run either end may be the stray digit."""
    for m in DIGITS.finditer(layer.text):
        for begin in range(1 + len(m.group()) % 2):
            start, size = m.start() + begin, len(m.group()) - len(m.group()) % 2
            raw = bytes.fromhex(layer.text[start : start + size])
            yield from _unfolded(raw, layer, lambda s, e, start=start: (start + 2 * s, start + 2 * e))


def _unfolded(raw: bytes, layer: Layer, place) -> Iterator[Layer]:
    """The layer of decoded bytes, and those of the compressed members that begin anywhere in them."""
    yield Layer(raw.decode("latin-1"), layer, place)
    at = 0
    while found := MEMBER.search(raw, at):
        full, end = False, -1
        for piece, end in _inflate(raw, found.start()):
            full = full or bool(piece)
        if full:
            whole = place(found.start(), end if end >= 0 else len(raw))
            for text in _texts(_inflate(raw, found.start())):
                yield Layer(text, layer, lambda s, e, whole=whole: whole)
        at = max(end, found.end())


def _layers(layer: Layer) -> Iterator[Layer]:
    """The layers that one step of decoding makes of a layer."""
    if "%" in layer.text and (new := _replaced(layer, PERCENT, _percent)):
        yield new
    if ("\\" in layer.text or "&" in layer.text) and (new := _replaced(layer, ESCAPE, _escape)):
        yield new
    if "\0" in layer.text and (new := _replaced(layer, ZERO, lambda s: [])):
        yield new
    yield from _payloads(layer)
    yield from _digits(layer)
    if ("\n" in layer.text or "\\n" in layer.text) and (joined := _replaced(layer, WRAP, lambda s: [])):
        joined.depth = layer.depth
        yield from _payloads(joined)
        yield from _digits(joined)


def find_secrets(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, depth) of all layers by start, then kind; depth 0: in the text itself."""
    spans = {(k, s, e): 0 for k, s, e in scan(text)}
    work, seen = [_layers(Layer(text))], set()
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        if not new.text:
            continue
        key = (hashlib.blake2b(new.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *new.origin(0, len(new.text)))
        if key in seen:
            continue
        seen.add(key)
        for kind, s, e in scan(new.text):
            spans.setdefault((kind, *new.origin(s, e)), new.depth)
        work.append(_layers(new))
    return sorted(((k, s, e, d) for (k, s, e), d in spans.items()), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Rows (doc_id, spans[, text]): spans of all layers with kind, start, end and depth."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("depth", pa.int32())]))

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            spans = [[dict(zip(("kind", "start", "end", "depth"), x)) for x in find_secrets(t.as_py() or "")] for t in texts]
            cols = [batch.column("doc_id"), pa.array(spans, kind), *([texts] if keep_text else [])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "spans", *(["text"] if keep_text else [])])
        give_back()

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, spans {SCHEMA}" + (", text string" if keep_text else ""))


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every maximal run of secrets in the text replaced; null stays null."""

    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text):
            if not text:
                return text
            out, at = [], 0
            for _, s, e, _ in find_secrets(text):
                if s >= at:
                    out += (text[at:s], mask)
                at = max(at, e)
            return "".join(out) + text[at:] if out else text

        for texts in batches:
            yield texts.map(one, na_action="ignore")
        give_back()

    bound_batches(docs.sparkSession)
    return docs.withColumn(text_col, F.pandas_udf(redact, "string")(F.col(text_col)))


def secret_digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: x["depth"] == 0)
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
