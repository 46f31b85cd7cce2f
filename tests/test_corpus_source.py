"""The corpus data source: round trip, refusals, and each version once as a stream."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

from verbatia.operators.corpus import build_corpus
from verbatia.sources.corpus_source import CorpusSource, publish, works_of

ROWS = [("b", 2, "two\nlines « ﷽ »"), ("a", 1, "the first"), ("b", 1, "one"), ("a", 2, "the 'second' \\ unit")]


def units(spark, rows=ROWS):
    return spark.createDataFrame(rows, "work string, unit long, text string").repartition(3)


def load(spark, path, **options):
    spark.dataSource.register(CorpusSource)
    return spark.read.format("corpus_units").options(path=path, **options).load()


def test_round_trip_of_the_newest_version(spark, tmp_path):
    publish(units(spark), str(tmp_path), 3, 100.0)
    publish(units(spark, ROWS[:2]), str(tmp_path), 12, 200.0)
    assert sorted(map(tuple, load(spark, str(tmp_path), version=3, works=2, units=4).collect())) == sorted((3, *x) for x in ROWS)
    assert sorted(map(tuple, load(spark, str(tmp_path)).collect())) == sorted((12, *x) for x in ROWS[:2])
    corpus = build_corpus(works_of(load(spark, str(tmp_path), version=3)))
    assert [x.fold for x in corpus.tokens.filter("work = 'b'").orderBy("pos").collect()] == ["one", "two", "lines"]


def test_incomplete_old_and_broken_versions_are_refused(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(Exception, match="no complete version"):
        load(spark, root).collect()
    publish(units(spark), root, 1, 100.0)
    for options, said in (({"units": 5}, "4 of 5 units"), ({"works": 3}, "2 of 3 works"), ({"now": 300, "max_age": 150}, "too old"), ({"version": 2}, "no complete version")):
        with pytest.raises(Exception, match=said):
            load(spark, root, **options).collect()
    assert load(spark, root, now=200, max_age=150).count() == 4
    with pytest.raises(Exception, match="there already"):
        publish(units(spark), root, 1, 100.0)
    with pytest.raises(Exception, match="there twice"):
        publish(units(spark, ROWS + ROWS[:1]), root, 2, 100.0)
    for bad in (("c", 1, "  "), ("c", 1, None), (None, 1, "text"), ("c", None, "text")):
        with pytest.raises(Exception, match="without work, number or text"):
            publish(units(spark, [*ROWS, bad]), root, 4, 100.0)
    with pytest.raises(Exception, match="without units"):
        publish(units(spark, ROWS).filter("false"), root, 5, 100.0)
    assert load(spark, root).first().version == 1
    manifest = tmp_path / "1" / "manifest.json"
    parts = json.loads(manifest.read_text())["parts"]
    part = Path(tmp_path / "1" / next(iter(parts)))
    part.write_text("".join(part.read_text().splitlines(keepends=True)[:-1]))
    with pytest.raises(Exception, match=r"\d of \d units in"):
        load(spark, root).collect()
    part.write_text('{"work": "a"}\n')
    with pytest.raises(Exception, match="wrong shape"):
        load(spark, root).collect()


def test_a_stream_gives_each_version_once_and_goes_on_where_it_stopped(spark, tmp_path):
    root, out, kept = (str(tmp_path / x) for x in ("corpus", "out", "kept"))
    spark.dataSource.register(CorpusSource)

    def drain():
        rows = spark.readStream.format("corpus_units").option("path", root).load()
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", kept).trigger(once=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).select("version", "work", "unit").collect()))

    publish(units(spark), root, 1, 100.0)
    (tmp_path / "corpus" / "2").mkdir()
    want = sorted((1, w, u) for w, u, _ in ROWS)
    assert drain() == want
    publish(units(spark, ROWS[:1]), root, 5, 200.0)
    publish(units(spark, ROWS[1:2]), root, 9, 300.0)
    assert drain() == sorted([*want, (5, "b", 2), (9, "a", 1)])
    assert drain() == sorted([*want, (5, "b", 2), (9, "a", 1)])
