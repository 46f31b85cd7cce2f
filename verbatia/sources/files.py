"""Files as rows: what they are by their first bytes, their text, or why they are refused."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatia.functions.normalize import clean_text

# First bytes of file formats, in hexadecimal, and the limits of a document archive.
MAGIC = (("504B0304", "zip"), ("D0CF11E0A1B11AE1", "cfb"), ("255044462D", "pdf"), ("7B5C727466", "rtf"), ("89504E47", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("EFBBBF", "utf8-bom"), ("FFFE", "utf16-le"), ("FEFF", "utf16-be"))
MAX_ENTRIES, MAX_UNFOLDED, MAX_RATIO = 5000, 20 << 20, 200
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def sniff(content: Column) -> Column:
    """The kind of a file by its first bytes; text where they say nothing else."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    for magic, kind in MAGIC:
        out = out.when(head.startswith(magic), kind)
    return out.otherwise("text")


def docx_text(raw: bytes) -> tuple[str | None, str | None]:
    """(text, refusal) of a word-processing archive: paragraphs by line, insertions kept and deletions left out."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            entries = z.infolist()
            if len(entries) > MAX_ENTRIES:
                return None, "too_many_entries"
            if sum(e.file_size for e in entries) > MAX_UNFOLDED or any(e.compress_size and e.file_size / e.compress_size > MAX_RATIO for e in entries):
                return None, "too_large"
            names = {e.filename for e in entries}
            if "word/document.xml" not in names:
                return None, "not_a_document"
            if any(e.flag_bits & 1 for e in entries):
                return None, "encrypted"
            parts = [z.read(n) for n in ("word/document.xml", "word/footnotes.xml", "word/endnotes.xml") if n in names]
    except (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, EOFError, NotImplementedError):
        return None, "damaged"
    if any(b"<!DOCTYPE" in p or b"<!ENTITY" in p for p in parts):
        return None, "damaged"
    lines = []
    for part in parts:
        try:
            root = ElementTree.fromstring(part)
        except ElementTree.ParseError:
            return None, "damaged"
        for p in root.iter(WORD + "p"):
            said = []
            for node in p.iter():
                tag = node.tag.removeprefix(WORD)
                said.append(node.text or "" if tag == "t" else "\t" if tag == "tab" else "\n" if tag in ("br", "cr") else "")
            lines.append("".join(said))
    return "\n".join(lines).strip("\n"), None


def extract_files(files: DataFrame, limit: int = 20_000) -> DataFrame:
    """(path, kind, ok, text, chars, code) of binary files: text, or the reason of a refusal; never a part of a text."""

    def read(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, what in zip(content, kind):
            if not raw:
                rows.append((None, "empty"))
            elif what == "zip":
                rows.append(docx_text(raw))
            elif what in ("text", "utf8-bom", "utf16-le", "utf16-be"):
                try:
                    text = raw.decode({"utf16-le": "utf-16", "utf16-be": "utf-16"}.get(what, "utf-8-sig"))
                    rows.append((None, "binary") if re.search("[\0-\x06]", text) else (text, None))
                except UnicodeDecodeError:
                    rows.append((None, "encoding"))
            else:
                rows.append((None, f"unsupported_{what}"))
        return pd.DataFrame(rows, columns=["text", "code"])

    known = files.select("path", "content", sniff(F.col("content")).alias("kind"))
    read_out = known.withColumn("r", F.pandas_udf(read, "text string, code string")("content", "kind")).select("path", "kind", clean_text(F.col("r.text")).alias("text"), F.col("r.code").alias("code"))
    code = F.when(F.col("code").isNotNull(), F.col("code")).when(F.length("text") == 0, "empty").when(F.length("text") > limit, "too_long")
    read_out = read_out.withColumn("code", code).withColumn("ok", F.col("code").isNull())
    return read_out.select("path", "kind", "ok", F.when(F.col("ok"), F.col("text")).alias("text"), F.length("text").alias("chars"), "code")


def read_files(spark: SparkSession, path: str, limit: int = 20_000) -> DataFrame:
    return extract_files(spark.read.format("binaryFile").load(path), limit)


def page_text(html: Column) -> Column:
    """Markup to plain text with built-in expressions: raw elements and tags removed, white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def provider_proposals(recorded: DataFrame) -> DataFrame:
    """Proposals of recorded calls (id, outcome, answer JSON): the answered call of an id stands for it; malformed answers give none."""
    shape = "struct<quotes:array<struct<quote:string,reference_text:string>>>"
    best = recorded.groupBy("id").agg(F.max_by("answer", F.struct((F.col("outcome") == "ok").cast("int"), "answer")).alias("answer"))
    parsed = F.from_json(F.regexp_replace("answer", r"^\s*```(?:json)?|```\s*$", ""), shape)
    return best.select("id", F.inline(parsed["quotes"]))
