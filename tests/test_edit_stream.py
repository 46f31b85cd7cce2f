"""Edits one after the other: findings stand where their words are found again, and a stream gives what a batch gives."""

from __future__ import annotations

import random

from verbatia.streaming.edits import Finding, apply_edit, edited, edited_stream, events

FOUND = "doc_id long, finding_id long, s long, e long, z0 long, z1 long"
EDIT = "doc_id long, seq long, start long, old_end long, new_end long"


def history(r: random.Random, doc: int, edits: int):
    """A text of unique words, findings over single words, and edits that leave the text at hand."""
    text = " ".join(f"w{doc}x{i}" for i in range(40))
    words = r.sample(text.split(), 8)
    found = [(doc, n, text.index(w + " ") if w + " " in text else text.index(w), 0, w) for n, w in enumerate(words)]
    found = [(d, n, s, s + len(w), w) for d, n, s, _, w in found]
    steps = []
    for seq in range(edits):
        a = r.randint(0, len(text))
        b, put = min(len(text), a + r.choice((0, 0, 1, 4))), "é" * r.choice((0, 1, 5))
        steps.append((doc, seq, a, b, a + len(put)))
        text = text[:a] + put + text[b:]
    return text, found, steps


def test_findings_are_where_their_words_are():
    r = random.Random(3)
    for doc in range(60):
        text, found, steps = history(r, doc, 6)
        now = [Finding(n, s, e, s, e) for _, n, s, e, _ in found]
        for _, _, a, b, c in steps:
            now = apply_edit(now, a, b, c)
        words = {n: w for _, n, _, _, w in found}
        assert all(text[f.s : f.e] == words[f.finding_id] for f in now if not f.stale)
        assert all(0 <= f.s < f.e <= len(text) and f.z0 <= f.s and f.e <= f.z1 for f in now)
        assert {n for n in words} - {f.finding_id for f in now} <= {n for n, w in words.items() if w not in text}


def test_what_an_edit_touches():
    at = lambda *e: [(f.s, f.e, f.stale) for f in apply_edit([Finding(1, 10, 20, 8, 22)], *e)]
    assert at(0, 3, 5) == [(12, 22, False)] and at(23, 25, 23) == [(10, 20, False)] and at(22, 22, 24) == [(10, 20, True)]
    assert at(5, 8, 5) == [(7, 17, True)] and at(12, 14, 12) == [(10, 18, True)] and at(5, 30, 6) == [(5, 6, True)] and at(5, 30, 5) == [] and at(15, 30, 17) == [(10, 17, True)]


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(9)
    all_found, all_steps = [], []
    for doc in range(12):
        _, found, steps = history(r, doc, 6)
        all_found += [(d, n, s, e, max(0, s - 1), e + 1) for d, n, s, e, _ in found]
        all_steps += steps
    found, edits = spark.createDataFrame(all_found, FOUND), spark.createDataFrame(all_steps, EDIT)
    want = sorted(map(tuple, edited(found, edits).collect()))
    assert len(want) > 50 and any(x[-1] for x in want)
    rows = events(found, edits)
    for part, cond in enumerate(("turn = 0 or seq < 2", "turn = 1 and seq between 2 and 3", "turn = 1 and seq > 3")):
        rows.filter(cond).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part{part}")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    batches: list[list] = []
    run = edited_stream(stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, n: batches.append(list(map(tuple, df.collect())))).start()
    run.processAllAvailable()
    run.stop()
    last: dict = {}
    for rows_ in batches:
        for doc in {x[0] for x in rows_}:
            last[doc] = [x for x in rows_ if x[0] == doc]
    assert len([b for b in batches if b]) == 3 and sorted(x for rows_ in last.values() for x in rows_) == want
