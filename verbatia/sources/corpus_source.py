"""The corpus as a Spark data source: versions of units, written whole or not at all, read in batch or as a stream.

A version is a folder of parts, one JSON record a line (work, unit, text), and a manifest that is written last and names the parts
with the number of their units. What the manifest does not name does not exist, so neither a task that ran twice nor a write that
failed shows. Parts are partitions; every task checks the part it reads and refuses a wrong record, an empty text or a wrong count,
so nothing incomplete is used as the corpus and no version passes through the driver.

    spark.dataSource.register(CorpusSource)
    units.write.format("corpus_units").option("path", root).option("version", 7).mode("append").save()
    spark.read.format("corpus_units").option("path", root).option("units", 6236).load()
    spark.readStream.format("corpus_units").option("path", root).load()

Options: ``path``; ``version`` (to read: the newest by default; to write: needed, whole and above 0); ``works`` and ``units``, the numbers that a complete corpus has (unchecked by
default); ``now`` and ``max_age`` in seconds of the version's ``fetched_at``: an older one is refused. A folder without a version is refused in batch, and an
empty stream. Extra columns of what is written are left out; a null is refused. The stream gives each version once, in order of number, from the first after the offset.
"""

from __future__ import annotations

import io
import json
import time
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "version bigint, work string, unit bigint, text string"
MANIFEST = "manifest.json"
ROWS = 10_000


class CorpusRefused(ValueError):
    """A corpus that is absent, too old, incomplete or of the wrong shape."""


@dataclass
class Part(InputPartition):
    path: str
    version: int
    units: int


@dataclass
class Written(WriterCommitMessage):
    part: str
    units: int


def _record(line: str) -> tuple[str, int, str]:
    try:
        row = json.loads(line)
        work, unit, text = row["work"], row["unit"], row["text"]
    except (ValueError, KeyError, TypeError) as e:
        raise CorpusRefused(f"a record of the wrong shape: {line[:80]!r}") from e
    if not isinstance(work, str) or type(unit) is not int or not isinstance(text, str) or not text.strip():
        raise CorpusRefused(f"a record without work, number or text: {line[:80]!r}")
    return work, unit, text


def _read(part: Part):
    system, path = fs.FileSystem.from_uri(part.path)
    names, n, rows = ["version", "work", "unit", "text"], 0, []

    def batch():
        work, unit, text = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array([part.version] * len(rows), pa.int64()), pa.array(work), pa.array(unit, pa.int64()), pa.array(text)], names)

    with system.open_input_stream(path) as raw:
        for line in io.TextIOWrapper(raw, "utf-8", newline="\n"):
            rows.append(_record(line))
            n += 1
            if len(rows) == ROWS:
                yield batch()
                rows.clear()
    if rows:
        yield batch()
    if n != part.units:
        raise CorpusRefused(f"{n} of {part.units} units in {part.path}")


class _Versions:
    """The complete versions below a folder."""

    def __init__(self, options):
        self.options = options
        if not options.get("path"):
            raise CorpusRefused("the option path is missing")
        self.root = options["path"].rstrip("/")

    def numbers(self) -> list[int]:
        system, root = fs.FileSystem.from_uri(self.root)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        names = [x.base_name for x in found if x.type == fs.FileType.Directory and x.base_name.isdigit()]
        sealed = system.get_file_info([f"{root}/{name}/{MANIFEST}" for name in names])
        return sorted(int(name) for name, x in zip(names, sealed) if x.type == fs.FileType.File)

    def parts(self, version: int) -> list[Part]:
        system, path = fs.FileSystem.from_uri(f"{self.root}/{version}/{MANIFEST}")
        with system.open_input_stream(path) as f:
            manifest = json.loads(f.read())
        units = sum(manifest["parts"].values())
        for name, n in (("works", manifest["works"]), ("units", units)):
            if name in self.options and int(self.options[name]) != n:
                raise CorpusRefused(f"{n} of {self.options[name]} {name} in version {version}")
        if "max_age" in self.options and float(self.options.get("now", time.time())) - manifest["fetched_at"] > float(self.options["max_age"]):
            raise CorpusRefused(f"version {version} is too old")
        return [Part(f"{self.root}/{version}/{part}", version, n) for part, n in sorted(manifest["parts"].items())]


class _Reader(_Versions, DataSourceReader):
    def partitions(self):
        known = self.numbers()
        version = int(self.options["version"]) if "version" in self.options else max(known, default=0)
        if version not in known:
            raise CorpusRefused(f"no complete version below {self.root}")
        return self.parts(version)

    def read(self, partition):
        return _read(partition)


class _StreamReader(_Versions, DataSourceStreamReader):
    def initialOffset(self):
        return {"version": 0}

    def latestOffset(self):
        return {"version": max(self.numbers(), default=0)}

    def partitions(self, start, end):
        return [part for v in self.numbers() if start["version"] < v <= end["version"] for part in self.parts(v)]

    def read(self, partition):
        return _read(partition)


class _Writer(_Versions, DataSourceWriter):
    def __init__(self, options):
        super().__init__(options)
        self.version, self.fetched_at = int(options.get("version", 0)), float(options.get("fetched_at", time.time()))
        if self.version < 1:
            raise CorpusRefused("the option version must be a whole number above 0")
        if self.version in self.numbers():
            raise CorpusRefused(f"version {self.version} is there already")

    def write(self, iterator):
        system, folder = fs.FileSystem.from_uri(f"{self.root}/{self.version}")
        system.create_dir(folder, recursive=True)
        part, n = f"part-{uuid.uuid4().hex}.json", 0
        with system.open_output_stream(f"{folder}/{part}") as out:
            for row in iterator:
                line = json.dumps({"work": row["work"], "unit": row["unit"], "text": row["text"]}, ensure_ascii=False)
                _record(line)
                out.write(line.encode("utf-8") + b"\n")
                n += 1
        return Written(part, n)

    def commit(self, messages):
        parts = {m.part: m.units for m in messages if m is not None and m.units}
        if not parts:
            raise CorpusRefused("a corpus without units")
        works = int(self.options.get("works", 0))
        if "units" in self.options and sum(parts.values()) != int(self.options["units"]):
            raise CorpusRefused(f"{sum(parts.values())} of {self.options['units']} units")
        system, folder = fs.FileSystem.from_uri(f"{self.root}/{self.version}")
        with system.open_output_stream(f"{folder}/{MANIFEST}.new") as out:
            out.write(json.dumps({"parts": parts, "works": works, "fetched_at": self.fetched_at}).encode())
        system.move(f"{folder}/{MANIFEST}.new", f"{folder}/{MANIFEST}")


class CorpusSource(DataSource):
    @classmethod
    def name(cls):
        return "corpus_units"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def publish(units: DataFrame, path: str, version: int, fetched_at: float) -> None:
    """Write (work, unit, text) as a version; its works and units are counted first, and a unit that is there twice is refused."""
    spark = units.sparkSession
    spark.dataSource.register(CorpusSource)
    rows = units.select(F.col("work").cast("string").alias("work"), F.col("unit").cast("long").alias("unit"), "text")
    n = rows.groupBy("work", "unit").agg(F.count("*").alias("n")).agg(F.count_distinct("work").alias("works"), F.sum("n").alias("units"), F.max("n").alias("most")).first()
    if (n.most or 0) > 1:
        raise CorpusRefused("a unit is there twice")
    out = rows.write.format("corpus_units").option("path", path).option("version", version).option("fetched_at", fetched_at)
    out.option("works", n.works).option("units", n.units or 0).mode("append").save()


def works_of(units: DataFrame) -> DataFrame:
    """(item_id, text) for ``build_corpus``: the units of each work in order, one a line."""
    lines = F.array_sort(F.collect_list(F.struct("unit", "text")))["text"]
    return units.groupBy(F.col("work").alias("item_id")).agg(F.array_join(lines, "\n").alias("text"))
