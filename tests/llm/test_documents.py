"""Operators on documents against brute force on a small fixture with nulls, empty, repeated, odd and very long texts."""

from __future__ import annotations

import base64
import functools
import gzip
import hashlib
import io
import math
import random
import re
import urllib.parse
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from verbatia.llm import decontaminate as decon
from verbatia.llm import html_text, katz, language, near_dedup, pieces, repeats, secrets, token_files
from verbatia.llm.work import Workspace, components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def spaced(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def find(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, texts, k):
    sets = []
    for _, t in texts:
        w = spaced(t)
        sets.append(frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = {i: i for i in range(len(texts))}
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 80 * (len(a) + len(sets[j]) - n):
                parent[find(parent, i)] = find(parent, j)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(texts):
        least[find(parent, i)] = min(least[find(parent, i)], d)
    want = Counter((d, len(sets[i]), least[find(parent, i)], d == least[find(parent, i)]) for i, (d, _) in enumerate(texts))
    got = near_dedup.near_duplicates(docs, shingle=k).drop("text_key").collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_sketches_estimate_similarity(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows, real = [], {}
    for i in range(60):
        base = r.sample(words, r.choice((20, 200, 900)))
        other = base[: len(base) * r.choice((17, 19, 20)) // 20]
        other = other + r.sample(words, len(base) - len(other))
        real[i] = len({*base} & {*other}) / len({*base} | {*other})
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_key", F.xxhash64("text"))
    got = near_dedup.signatures(docs, 1, near_dedup.BANDS, near_dedup.ROWS)
    pairs = got.alias("a").join(got.alias("b"), F.col("b.doc_id") == F.col("a.doc_id") + 1).filter("a.doc_id % 2 = 0")
    samples = near_dedup.BANDS * near_dedup.ROWS
    said = {x.doc_id // 2: (x.s, x.alike) for x in pairs.select("a.doc_id", near_dedup.estimate(samples).alias("s"), near_dedup.alike(80, samples).alias("alike")).collect()}
    assert all(abs(said[i][0] - real[i]) < 0.16 for i in real)
    assert sum(abs(said[i][0] - real[i]) for i in real) / len(real) < 0.03
    assert all(said[i][1] for i in real if real[i] >= 0.8)


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.6, 0.7, 0.95])
def test_most_bits_apart_are_where_the_estimate_passes(similarity):
    most, bits, k = near_dedup.most_apart(similarity, 200), near_dedup.BITS, 200
    said = [1 + bits / (4 * k) * math.log(1 - 2 * x / bits) for x in range(bits // 2)]
    assert [x for x, s in enumerate(said) if s > similarity] == list(range(most + 1))


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    parent = {i: i for e in edges for i in e}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.comp for x in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t"), "c").collect()}
    assert got == {x: find(parent, x) for e in edges if e[0] != e[1] for x in e}


def test_repeats(docs, texts):
    raw = [(d, (t or "").encode()) for d, t in texts]
    count = Counter(b[i : i + 200] for _, b in raw for i in range(len(b) - 199))
    want = []
    for d, b in raw:
        hit = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                hit[i : i + 200] = b"\1" * 200
        spans = len(re.findall(b"\1+", bytes(hit)))
        want.append((d, len(b), sum(hit), spans, sha(bytes(c for c, h in zip(b, hit) if not h))))
    got = repeats.repeat_digest(repeats.remove_repeats(docs)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_segments_hold_every_window_once(monkeypatch):
    import pyarrow as pa

    r = random.Random(8)
    text = "".join(r.choice("abcdefgh") for _ in range(5000))
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    windows = []
    for row, data, offsets, base in repeats._segments(pa.array([text]), 200):
        _, first, last, *_ = repeats._owned(data, offsets, 200, 64)
        assert row == 0
        windows += [base + w for a, b in zip(first, last) for w in range(a, b + 1)]
    assert sorted(windows) == list(range(5000 - 199))


def test_pieces_equal_the_library(docs, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((r.doc_id, r.ids, r.decoded) for r in pieces.encode_pieces(docs, path).collect())
    assert got == sorted((d, sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for d, t in texts)
    coded = pieces.encode_pieces(docs, path, keep=("lang",))
    assert coded.columns == ["doc_id", "ids", "decoded", "lang"]
    assert pieces.decode_pieces(coded, path).filter("text is null").count() == 0


def test_pieces_on_odd_text():
    import pyarrow as pa
    import sentencepiece

    from verbatia.llm.bytes_np import chunks

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, segment = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Segmenter(path)
    r = random.Random(1)
    parts = [" ", "  ", "\n", "a", "th", "▁", "é", "ﬁ", "\t", "<s>", "<0x41>", "世", "👍", "\0", "1", ".", "\r", "\n\n"]
    cases = ["".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(4000)]
    got = [y for _, _, d, o in chunks(pa.array(cases)) for y in segment(d, o)]
    assert all((ids.tolist(), said) == (sp.encode(t), sp.decode(sp.encode(t))) for t, (ids, said) in zip(cases, got))


@pytest.mark.parametrize("most", [4 << 20, 500])
def test_token_files_round_trip(spark, docs, texts, monkeypatch, most):
    import pyarrow.fs
    import tokenizers

    monkeypatch.setattr(token_files, "FILE_TOKENS", most)
    monkeypatch.setattr(token_files, "READ_DOCS", 7)
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 1000)

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    files = token_files.write_tokens(docs, path, 2, Workspace(spark, "tok"))
    rows = files.orderBy("start").collect()
    assert most > 500 or len(rows) > len({r.part for r in rows})
    want = sorted((d, lib.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in texts)
    fs, place = pyarrow.fs.FileSystem.from_uri(rows[0].path)
    with fs.open_input_file(place) as source:
        one = token_files.TokenFile(source)
        assert [(one.doc_ids(i, i + 1)[0], one.document(i).tolist()) for i in reversed(range(one.documents))] == want[: one.documents][::-1]
    got = sorted((r.start, r.doc_id, np.frombuffer(r.ids_le, "<u4").tolist()) for r in token_files.read_tokens(files).collect())
    want = sorted((d, lib.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in texts)
    assert sorted(x[1:] for x in got) == want and [x[1] for x in got] == sorted(d for d, _ in texts)
    assert all(b[0] - a[0] == len(a[2]) for a, b in zip(got, got[1:])) and got[0][0] == 0


def test_tokeniser_on_odd_text():
    import pyarrow as pa

    from verbatia.llm.bytes_np import chunks

    t = token_files.Tokeniser(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(1)
    parts = [" ", "  ", "\n", "a", "th", "'s", "'", "é", "ﬁ", "\t", "<|endoftext|>", "²", "世", "\0", "1", ".", "\r", "́", "\xa0", "_"]
    cases = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    got = [y.tolist() for _, _, d, o in chunks(pa.array(cases)) for y in t(d, o)]
    assert got == [t.lib.encode(c, add_special_tokens=False).ids for c in cases]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000])
def test_elias_fano(n):
    v = np.sort(np.random.default_rng(n).integers(0, 10**9, n))
    code = token_files.EliasFano.load(io.BytesIO(token_files.EliasFano.of(v).dump()))
    places = np.random.default_rng(n).permutation(n)
    assert code.select(places).tolist() == v[places].tolist()
    assert not n or len(code.high) + len(code.low) <= n * (3 + math.log2(max(2, int(v[-1]) / n))) / 8 + 16


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_decontamination(spark, docs, texts, monkeypatch, block):
    monkeypatch.setattr(decon, "BLOCK_BYTES", block)
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    long = [cut(t) for _, t in texts if len(cut(t)) > 60]
    items = [(i, " ".join(w[20:50]).upper()) for i, w in enumerate(long[:12])] + [(50, "one"), (51, None), (52, "..."), (50, "one"), (60, "the of"), (100, " ".join(long[3][22:40]))]
    windows = []
    for i, t in items:
        w = cut(t)
        n = min(13, len(w))
        windows += [(str(i), tuple(w[s : s + n])) for s in range(len(w) - n + 1)] if w else []
    want = []
    for d, t in texts:
        w = cut(t)
        hit, found = [False] * len(w), set()
        places = defaultdict(list)
        for p, x in enumerate(w):
            places[x].append(p)
        for i, win in windows:
            for p in places[win[0]]:
                if tuple(w[p : p + len(win)]) == win:
                    hit[p : p + len(win)] = [True] * len(win)
                    found.add(i)
        n = sum(hit)
        want.append((d, len(w), n, len(found), sha(",".join(sorted(found))), n > 0 and 20 * n >= len(w)))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("hits", F.lit(1))
    assert sorted(map(tuple, decon.contamination(decon.decontaminate(docs, bench)).collect())) == sorted(want)
    none = decon.contamination(decon.decontaminate(docs, bench.filter("false"))).agg(F.sum("n_hit")).first()[0]
    assert none == 0


@pytest.mark.parametrize(("order", "hot"), [(1, 256), (2, 256), (3, 256), (3, 4000), (4, 256)])
def test_katz(docs, texts, monkeypatch, order, hot):
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "PACK_BYTES", 40_000)
    rows = [(d, spaced(t) + ["</s>"]) for d, t in texts]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    grams = lambda w, k: list(zip(*[(["<s>"] * (k - 1) + w)[i:] for i in range(k)]))
    counts = {k: Counter(g for d, w in rows if not held(d) for g in grams(w, k)) for k in range(1, order + 1)}
    n, kinds = sum(counts[1].values()), len(counts[1])

    def discount(counts):
        of = Counter(counts.values())
        tail = 6 * of[6] / of[1]
        out = {}
        for c in range(1, 6):
            v = ((c + 1) * of[c + 1] / (c * of[c]) - tail) / (1 - tail) if of[c] and tail != 1 else 0
            out[c] = v if 0 < v < 1 else (c - 0.5) / c
        return out

    d = {k: discount(c) for k, c in counts.items()}
    after = defaultdict(list)
    for k in range(2, order + 1):
        for g, c in counts[k].items():
            after[g[:-1]].append((g[-1], c))
    unseen = 1 - sum(d[1].get(c, 1) * c / n for c in counts[1].values())

    @functools.cache
    def back(h):
        """Tokens, share kept and backoff weight of a context."""
        k, tokens = len(h) + 1, sum(c for _, c in after[h])
        whole = all(c > 5 for _, c in after[h])
        left = 1 / (tokens + 1) if whole else 1 - sum(d[k].get(c, 1) * c for _, c in after[h]) / tokens
        return tokens, tokens / (tokens + 1) if whole else 1, left / (1 - sum(p(h[1:], w) for w, _ in after[h]))

    @functools.cache
    def p(h, w):
        if not h:
            c = counts[1][w,]
            return d[1].get(c, 1) * c / n if c else unseen
        if h not in after:
            return p(h[1:], w)
        tokens, kept, weight = back(h)
        c = counts[len(h) + 1][h + (w,)]
        return kept * d[len(h) + 1].get(c, 1) * c / tokens if c else weight * p(h[1:], w)

    # Every distribution sums to one: all known words and the unseen ones together.
    for h in random.Random(3).sample(sorted(after), min(40, len(after))):
        assert sum(p(h, w) for w, in counts[1]) + p(h, None) == pytest.approx(1, rel=1e-9)
    want = {}
    for i, w in rows:
        score = sum(math.log10(p(g[:-1], g[-1])) for g in grams(w, order))
        want[i] = held(i), len(w), sum((y,) in counts[1] for y in w), n, sum(math.log10((counts[1][y,] + 1) / (n + kinds + 1)) for y in w), score
    got = katz.score_documents(docs, "crc32(cast(cast(doc_id as string) as binary)) % 7 = 2", order=order).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id][:4]
        assert tuple(r)[5:] == pytest.approx(want[r.doc_id][4:], rel=1e-9)


def test_counts_of_many_bits_survive_packing():
    x = np.array([0, 3, 2**32 + 5, 2**62], np.int64)
    assert katz._load(katz._dump(x)).tolist() == katz._load(katz._dump(x, True)).tolist() == x.tolist()
    assert katz._load(katz._dump(np.array([0.1, -2.5])), np.float64).tolist() == [0.1, -2.5]
    assert len(katz._load(katz._dump(np.zeros(0, np.int64)))) == 0


def test_katz_without_training_documents(docs):
    rows = katz.score_documents(docs.limit(5), "true").collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == r.base_score == 0 for r in rows)


def test_language(spark, docs):
    r = random.Random(2)
    kinds = {"aa": "abcde", "bb": "lmnop", "cc": "абвгд"}
    rows = []
    for i in range(120):
        lang = r.choice(list(kinds))
        rows.append((i, " ".join("".join(r.choice(kinds[lang]) for _ in range(5)) for _ in range(30)), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn_languages(df.filter("doc_id % 4 != 2"))
    odd = spark.createDataFrame([(500, None, None), (501, "", None), (502, "123 !?", "aa"), (503, "abcde", None)], df.schema)
    got = {x.doc_id: x.p for x in language.identify(df.union(odd), model, out="p").collect()}
    assert all(got[i].lang == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)
    assert [got[i].lang for i in (500, 501, 502, 503)] == ["und", "und", "und", "aa"] and got[500].score == 0
    assert {x.p.lang for x in language.identify(odd, {}, out="p").collect()} == {"und"}


@pytest.mark.parametrize("before", ["<script>for(i=0;i<n;i++){x='a';}</script>", "<svg><g><svg><text>no</text></svg><text>nor</text></svg>"])
def test_formulas_stay_and_raw_elements_go(before):
    blocks = html_text.leaf_blocks(before + "<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be <object>shown</object>.</p>")
    assert " ".join(t for t, *_ in blocks) in ("Let x=1 be shown.", "Let x=1 be shown .")


def test_secret_layers():
    secret = "password=abcdefghijklmnop"
    b64 = lambda b: base64.b64encode(b).decode()
    for wrapped in (
        b64(b"hello " + secret.encode() + b" bye"),
        b64(gzip.compress(secret.encode())),
        b64(zstandard.compress(b64(secret.encode()).encode())),
        urllib.parse.quote(b64(zlib.compress(secret.encode())), safe=""),
        "".join(f"\\u{ord(c):04x}" for c in secret),
        "".join(f"%{ord(c):02X}" for c in secret),
        secret.replace("a", "&#97;"),
    ):
        text = "before 😀 " + wrapped + " after"
        spans = [s for s in secrets.find_secrets(text) if s[0] == "assign"]
        assert spans and all(9 <= s < e <= 9 + len(wrapped) for _, s, e, _ in spans), wrapped
        assert all(d > 0 for *_, d in spans) or wrapped.startswith("p")


SECRET = "password=abcdefghijklmnop"


def b64(raw: bytes | str) -> str:
    return base64.b64encode(raw.encode() if isinstance(raw, str) else raw).decode()


def found(text: str) -> set[str]:
    return {k for k, *_ in secrets.find_secrets(text)}


def test_secrets_of_large_payloads_and_later_members(monkeypatch):
    r = random.Random(4)
    noise = b" ".join(b"%x," % r.getrandbits(40) for _ in range(3000))
    monkeypatch.setattr(secrets, "INFLATE_LIMIT", 1 << 12)
    for inner in (b64(SECRET), b64(gzip.compress(SECRET.encode())), "".join(f"%{ord(c):02X}" for c in SECRET), "".join(f"\\u{ord(c):04x}" for c in SECRET), b64(b64("x" * 9000 + SECRET))):
        for pack in (gzip.compress, zlib.compress, zstandard.compress):
            text = "a " + b64(pack(noise + inner.encode() + b"\n" + noise)) + " z"
            assert {(k, s, e) for k, s, e, _ in secrets.find_secrets(text) if k == "assign"} == {("assign", 2, len(text) - 2)}
    first, secret = b"nothing here, ", SECRET.encode()
    for pack in (gzip.compress, zlib.compress, zstandard.compress):
        assert found(b64(pack(first) + pack(secret))) == {"assign"}
        assert found(b64(pack(first) + b"\0\0" + pack(secret[:12]) + pack(secret[12:]))) == {"assign"}
    assert found(b64(gzip.compress(first) + b"\x50\x2a\x4d\x18\x02\0\0\0ab" + zstandard.compress(secret))) == {"assign"}
    assert found(b64(gzip.compress(secret * 9 + noise)[:-3000])) == {"assign"}


@pytest.mark.parametrize("odd", ["\u00a0", "\ufeff", "\u200b", "\f", "\0", "\xff", "\x80\x81", "é\u0085"])
def test_secrets_beside_characters_that_do_not_print(odd):
    for raw in (f"token{odd}{odd}... {SECRET}".encode(), f"token{odd}... {SECRET}".encode("latin-1", "ignore"), f"{SECRET}\n{odd}".encode()):
        assert found("x " + b64(raw)) == {"assign"}
        assert found(b64(b"\0" + b64(raw).encode())) == {"assign"}


@pytest.mark.parametrize("joint", ["-", "_", "/", "+", "--", "/_"])
def test_secrets_in_every_part_of_a_joined_run(joint):
    for n in range(3):
        first, last = f"some words {'x' * n}", f"id {'y' * n} {SECRET}!"
        text = joint.join(b64(x).rstrip("=") for x in (first, last, first, last))
        at = len(b64(first).rstrip("=")) + len(joint)
        spans = [(s, e) for k, s, e, _ in secrets.find_secrets(text) if k == "assign"]
        begin, end = at + (3 + n + 1) * 4 // 3, at - -(3 + n + 1 + len(SECRET)) * 4 // 3
        assert len(spans) == 2 and spans[0][0] == begin and end <= spans[0][1] <= end + 1
        for pack in (gzip.compress, zlib.compress, zstandard.compress):
            parts = [b64(pack(x.encode())).rstrip("=") for x in (first, last)]
            assert found(joint.join(parts)) == found(joint.join(parts).translate({43: "-", 47: "_"})) == {"assign"}
            assert found(joint.join((b64(first).rstrip("="), b64(b64(last)).rstrip("="), parts[0]))) == {"assign"}


def test_secret_bases(docs, texts):
    sample = ["token=token:abcdefghijklmnop", 'API_KEY : "AbCdEfGhIjKl"', "AKIAABCDEFGHIJKLMN AKIASHORT", "x 0123456789abcdef0 y", "ſecret=abcdefghijklmnop", None, ""]

    def base(text):
        text = text or ""
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))

    rows = [(i, t) for i, t in enumerate(sample)]
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    for data, pairs in ((df, rows), (docs, texts)):
        got = sorted((r.doc_id, r.base_sha256) for r in secrets.secret_digest(secrets.scan_secrets(data)).collect())
        assert got == sorted((i, sha(base(t))) for i, t in pairs)
    masked = {r.doc_id: r.text for r in secrets.redact_secrets(df).collect()}
    assert masked[3] == "x [SECRET] y" and masked[5] is None and masked[6] == ""


def test_self_reproducing_layers_end():
    text = "a"
    for _ in range(12):
        text = base64.b64encode(("%41" + text).encode()).decode()
    assert secrets.find_secrets(text) == []


def test_html_field_on_unseen_pages():
    field, right, total = html_text.default_field(), 0, 0
    for seed in range(50_000, 50_150):
        page, labels = html_text.labelled_page(random.Random(seed))
        got = field.decode(html_text.features(html_text.leaf_blocks(page)))
        assert len(got) == len(labels)
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.98


def test_viterbi_is_the_best_path():
    r = random.Random(3)
    field = html_text.Field({f: (r.gauss(0, 1), r.gauss(0, 1)) for f in "abcdef"}, [[0.5, -0.7], [-0.2, 0.9]])
    for _ in range(100):
        blocks = [[r.choice("abcdef") for _ in range(3)] for _ in range(r.randint(1, 7))]

        def score(y):
            return sum(field.weights[f][l] for fs, l in zip(blocks, y) for f in fs) + sum(field.steps[a][b] for a, b in zip(y, y[1:]))

        paths = [[n >> i & 1 for i in range(len(blocks))] for n in range(1 << len(blocks))]
        assert score(field.decode(blocks)) == pytest.approx(max(map(score, paths)))


@pytest.mark.parametrize(
    "raw",
    [
        "<script>for(i=0;i<n;i++){f(i)}</script>",
        "<script>if (a <b && c) { s = '<!-- '; }</SCRIPT >",
        "<script>s = \"it's <a href='\"; // don't</script\n>",
        "<script>'</scripts>'</script/>",
        "<style>p::before { content: '<x' }</style>",
        "<textarea><!-- </textarea>",
        "<svg><script>i<n;</script><path d='M0'/></svg>",
    ],
)
def test_html_raw_elements_end_at_their_end_tag(raw):
    page = f"<body>{raw}<article><p>one <b>two</b></p>{raw}<p>three</p></article>"
    assert [b[0] for b in html_text.leaf_blocks(page)] == ["one two", "three"]
    assert html_text.leaf_blocks("<p>one</p><script>i<n; <p>two</p>") == [("one", ("t=p",), 0)]


def test_html_pages(spark):
    page = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>A &amp; b</h1><p><b>One\n two.<br><p>Three&nbsp;&eacute;</article><footer>&copy; me</footer>"
    rows = [(1, page), (2, None), (3, ""), (4, "<"), (5, "<script>x</script"), (1, page)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit(None).cast("string"))
    got = sorted((r.page_id, r.text) for r in html_text.extract_text(df).collect())
    assert [t for i, t in got if i == 1] == ["A & b One two. Three é"] * 2
    assert [t for i, t in got if i in (2, 3, 5)] == ["", "", ""]


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert near_dedup.near_duplicates(empty).count() == 0
    assert repeats.remove_repeats(empty).count() == 0
    assert pieces.encode_pieces(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    files = token_files.write_tokens(empty, public_tokenizers.path("byte_bpe_50k.json"), 2, Workspace(spark, "none"))
    assert token_files.read_tokens(files).count() == 0
    assert decon.decontaminate(empty, bench).count() == 0
    assert katz.score_documents(empty, "false").count() == 0
    assert language.learn_languages(empty) == {}
    assert secrets.scan_secrets(empty).count() == 0
    assert html_text.extract_text(empty.select(F.col("text").alias("html"))).count() == 0
