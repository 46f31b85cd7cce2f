"""Registered queries without SQL, on the smallest tables."""

from __future__ import annotations

import re
from itertools import pairwise

from verbatia.plans.rules import QUERIES

DATA = "/root/testdata/sf0.001"


def test_written_citations(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["written_citations"](spark, DATA).collect()
    assert all(texts[r.doc_id][r.s : r.e] == r.found for r in rows)
    numeric = re.compile(r"(?<![\d:.])(?<!\d )(\d{1,3})\s*:\s*(\d{1,3})(?:\s*[-–—]\s*(\d{1,3}))?(?![\d:])")
    want = {(i, m.start(), int(m[1]), int(m[2])) for i, t in texts.items() for m in numeric.finditer(t or "")}
    assert want <= {(r.doc_id, r.s, r.work, r.unit0) for r in rows}


def test_merged_candidates_are_disjoint(spark):
    by_doc: dict = {}
    for r in QUERIES["merged_candidates"](spark, DATA).collect():
        by_doc.setdefault(r.doc_id, []).append((r.d0, r.d1, r.source, r.announced, r.hints))
    assert by_doc and {x[2] for rows in by_doc.values() for x in rows} <= {"run", "cue"}
    for rows in by_doc.values():
        assert all(a[1] <= b[0] for a, b in pairwise(sorted(rows))) and all(x[4] and x[0] < x[1] for x in rows)


def test_exact_quotations_are_not_corrected(spark):
    rows = QUERIES["wording_proposals"](spark, DATA).collect()
    assert all((r.status == "proposed") == bool(r.edits) for r in rows)
    assert not [r for r in rows if r.occurrences and r.edits]
