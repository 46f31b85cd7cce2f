"""Katz backoff model of any order over a whole corpus, and the score of every document.

Tokens are lower-cased (A-Z) words without ASCII white space, then one end per document; before the first stand starts. With c, the
training count, d, the Good-Turing discounts of an order for counts up to ``DISCOUNTED``, N, all training tokens, h, a
context and h', the context without its first word:

    p(w)     = d[c(w)] c(w) / N;  the rest of the mass belongs to unseen words together
    p(w | h) = d[c(h w)] c(h w) / c(h)           if c(h w) > 0
             = a(h) p(w | h')                    otherwise, a(h) = (1 - sum of the above) / (1 - sum of p(w | h') of the seen w)

so that every distribution sums to one; an unseen context gives p(w | h'). A context (or the unigrams) without
a discounted count keeps c / (c + 1) of its mass. Discounts that the counts of counts do not give between 0 and 1 become
(c - 1/2) / c.

Documents are held in packs of about ``PACK_BYTES`` of text, stored bucketed by pack. Counts live in
tables partitioned by hash: order by order, every pack sends its distinct n-grams with their training
counts to their partitions, each partition adds them up, keeps the totals, and returns to every pack the
totals of what it sent, with the sums of a(h) for contexts that need them. The partitions of words number them, so that longer n-grams
are exact tuples of numbers. An n-gram's partition follows from its context; the few contexts (at most ``HOT`` of
an order) with more than N / HOT tokens spread theirs over several partitions by the last word. A task holds
one pack or one partition, both bounded, and a row holds at least one n-gram, so rows never outnumber tokens; the driver sees
one row of counts of counts an order and the hot contexts' sums. A word is identified by 64 bits of hash.

Cases: a null or empty text has the end only. Without training documents every score is 0. Repeated rows count each
time. Null ids are not held out. Texts of any length pass whole. Only the named columns are read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatia.llm.bytes_np import SPACED, U, Words, chunks, mix
from verbatia.llm.work import Workspace, give_back

PACK_BYTES = 5 << 20
DISCOUNTED = 5
HOT = 256
PART_BYTES = 6 << 20
END = mix(np.array([1], U) * U(0x9FB21C651E98DF25))[0]


def _dump(x: np.ndarray, ascending: bool = False) -> bytes:
    """Integers (by their differences if ascending) or doubles, byte by byte of equal weight, compressed."""
    x = np.ascontiguousarray(x)
    x = x.view(U) if x.dtype == np.float64 else x.astype(U)
    if ascending and len(x):
        x = np.diff(x, prepend=U(0))
    return zstandard.compress(bytes([ascending]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _load(raw: bytes, kind=np.int64) -> np.ndarray:
    raw = zstandard.decompress(raw)
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=1).reshape(8, -1).T).view(U).ravel()
    return (np.cumsum(x, dtype=U) if raw[0] else x).view(kind)


def _loads(rows, kind=np.int64) -> np.ndarray:
    return np.concatenate([_load(x, kind) for x in rows])


def discounts(n: list[float]) -> np.ndarray:
    """Good-Turing discounts of counts 0 to DISCOUNTED + 1 from the numbers of types with counts 1 to DISCOUNTED + 1; the last is 1."""
    n = [0, *n]
    d = np.ones(DISCOUNTED + 2)
    tail = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1] if n[1] else 1.0
    for c in range(1, DISCOUNTED + 1):
        ratio = (c + 1) * n[c + 1] / (c * n[c]) if n[c] else 0.0
        value = (ratio - tail) / (1 - tail) if tail != 1 else 0.0
        d[c] = value if 0 < value < 1 else (c - 0.5) / c
    return d


_PACK = "pack long, size long, doc_id array<long>, held_out array<boolean>, begin binary, at binary, words binary, counts binary"


def _packs(docs: DataFrame, held: str) -> DataFrame:
    """Packs of documents: ids, flags, the first token of each, the tokens as places among the distinct words, these words' hashes and training counts."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        names, flags, count, hashes, size = [], [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal seq, names, flags, count, hashes, size
            each, words = np.concatenate(count), np.concatenate(hashes)
            begin = np.concatenate([[0], np.cumsum(each + 1)])
            token = np.full(begin[-1], END, U)
            token[np.arange(len(words)) + np.repeat(np.arange(len(each)), each)] = words
            known, at = np.unique(token, return_inverse=True)
            train = np.repeat(~np.array(flags, bool), each + 1)
            row = _row(_SCHEMAS["pack"], pack=part << 24 | seq, size=size, doc_id=names, held_out=flags, begin=_dump(begin, True), at=_dump(at), words=_dump(known, True), counts=_dump(np.bincount(at[train], minlength=len(known))))
            names, flags, count, hashes, size, seq = [], [], [], [], 0, seq + 1
            return row

        for batch in batches:
            ids, held_out = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
            for lo, hi, data, offsets in chunks(batch.column("text")):
                w = Words(data, offsets, SPACED)
                names += ids[lo:hi]
                flags += held_out[lo:hi]
                count.append(w.count)
                hashes.append(w.hash)
                size += len(data)
                if size >= PACK_BYTES:
                    yield close()
        if names:
            yield close()
        give_back()

    return docs.select("doc_id", "text", F.expr(held).alias("held_out")).mapInArrow(run, _PACK)


_ASK = "part int, pack long, contexts binary, degrees binary, hot binary, below binary, words binary, totals binary, counts binary"
_TOLD = "pack long, part int, totals binary, ids binary, open binary, classes binary, seen binary, context array<long>, sums array<double>"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<boolean>": pa.list_(pa.bool_())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


_SCHEMAS = {"pack": _schema(_PACK), "ask": _schema(_ASK), "told": _schema(_TOLD)}


def _row(schema: pa.Schema, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: [values.get(f.name)] for f in schema}, schema)


def _each_row(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _counts_of_counts(total: np.ndarray) -> list[float]:
    return np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2].astype(float).tolist()


def _split(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by partition, and the partitions' ends in it."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _word_parts(words: np.ndarray, parts: int) -> np.ndarray:
    return ((words >> U(20)) % U(parts)).astype(np.int64)


def _add_words(parts: int):
    """Totals and numbers of a partition's words: the most frequent have the smallest numbers; 0 is the start's."""

    def add(rows: pa.Table) -> pa.Table:
        part, packs = rows["part"][0].as_py(), rows["pack"].to_pylist()
        words = [_load(x, U) for x in rows["words"].to_pylist()]
        known, back = np.unique(np.concatenate(words), return_inverse=True)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, back, _loads(rows["counts"].to_pylist()))
        rank = np.empty(len(known), np.int64)
        rank[np.lexsort((known, -total))] = np.arange(len(known))
        number = 1 + part + rank * parts
        out = [_row(_SCHEMAS["told"], pack=-1, part=part, sums=[*_counts_of_counts(total), float(total.sum()), float((total > 0).sum())])]
        for k, own in zip(packs, np.split(back, np.cumsum([len(w) for w in words])[:-1])):
            out.append(_row(_SCHEMAS["told"], pack=k, part=part, totals=_dump(total[own]), ids=_dump(number[own])))
        return pa.Table.from_batches(out)

    return add


def _place(columns: np.ndarray) -> np.ndarray:
    """Numbers of the rows of a matrix: equal for equal rows, from 0."""
    out = np.unique(columns[:, 0], return_inverse=True)[1]
    for c in range(1, columns.shape[1]):
        out = np.unique(out << 32 | np.unique(columns[:, c], return_inverse=True)[1], return_inverse=True)[1]
    return out


def _add_grams(order: int, below):
    """Totals of a partition's n-grams, and the sums of its contexts where a pack needs them; below: probability in the shorter context."""

    def add(rows: pa.Table) -> pa.Table:
        part, packs = rows["part"][0].as_py(), rows["pack"].to_pylist()
        load = lambda name: [_load(x) for x in rows[name].to_pylist()]
        degrees, hot, base = load("degrees"), load("hot"), load("below")
        heads = np.concatenate([x.reshape(order - 1, -1).T for x in load("contexts")])
        slot = _place(heads)
        degree, contexts = np.concatenate(degrees), slot.max() + 1
        of = np.repeat(slot, degree)
        _, first, back = np.unique(of << 32 | np.unique(np.concatenate(load("words")), return_inverse=True)[1], return_index=True, return_inverse=True)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, back, np.concatenate(load("counts")))
        live, owner = total > 0, of[first]
        classes = np.stack([np.bincount(owner[total == c], minlength=contexts) for c in range(1, DISCOUNTED + 1)], axis=1)
        under = below(np.concatenate(load("totals"))[first], np.repeat(np.concatenate(base), degree)[first])
        seen = np.bincount(owner[live], under[live], contexts)
        out = [_row(_SCHEMAS["told"], pack=-1, part=part, sums=_counts_of_counts(total))]
        spread = np.concatenate(hot) > 0
        for s, i in zip(*np.unique(slot[spread], return_index=True)):
            out.append(_row(_SCHEMAS["told"], pack=-2, part=part, context=heads[spread][i].tolist(), sums=[*classes[s].astype(float).tolist(), float(seen[s])]))
        own, at, head_at = total[back], 0, 0
        for k, d, far in zip(packs, degrees, hot):
            mine, head = own[at : at + d.sum()], slot[head_at : head_at + len(d)]
            at, head_at = at + len(mine), head_at + len(d)
            needs = np.minimum.reduceat(mine, np.cumsum(d) - d) == 0
            ask = np.flatnonzero((needs | (classes[head].sum(axis=1) == 0)) & (far == 0))
            out.append(_row(_SCHEMAS["told"], pack=k, part=part, totals=_dump(mine), open=_dump(ask, True), classes=_dump(classes[head[ask]].ravel()), seen=_dump(seen[head[ask]])))
        del heads, slot, of, first, back, total, owner, own, under
        give_back()
        return pa.Table.from_batches(out)

    return add


class Model:
    """What is known of the whole corpus: totals, discounts by order, hot contexts' sums by order."""

    def __init__(self, parts: int, starts: int, stats: list[float]):
        self.parts, self.starts = parts, starts
        self.total, self.kinds = int(stats[-2]), int(stats[-1])
        self.d, self.spread = [discounts(stats[:-2])], [{}]
        spent = sum((1 - self.d[0][c]) * c * stats[c - 1] for c in range(1, DISCOUNTED + 1))
        self.keep = 1.0 if spent else self.total / (self.total + 1)
        self.unseen = spent / self.total if spent else 1 / (self.total + 1)

    def p_word(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.keep * self.d[0][np.minimum(c, DISCOUNTED + 1)] * c / max(1, self.total), self.unseen)

    def below(self, order: int):
        """Probability of a seen n-gram of one order less by its count and by twice its context's count, odd if nothing is discounted there."""
        if order == 2:
            return lambda c, base: self.p_word(c)
        d = self.d[order - 2]

        def seen(c: np.ndarray, base: np.ndarray) -> np.ndarray:
            n = np.maximum(1, base >> 1)
            return np.where(base & 1, n / (n + 1), 1.0) * d[np.minimum(c, DISCOUNTED + 1)] * c / n

        return seen


class Pack:
    """The n-grams of a pack, order by order; words stand in the order of their numbers."""

    def __init__(self, row: dict, model: Model):
        self.model = model
        self.begin = _load(row["begin"])
        words, told = _load(row.pop("words"), U), row.pop("t1")
        by_part, _ = _split(_word_parts(words, model.parts), model.parts)
        totals, ids = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        totals[by_part], ids[by_part] = _loads(t["totals"] for t in told), _loads(t["ids"] for t in told)
        order = np.argsort(ids)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.word_at = rank.astype(np.int32)[_load(row.pop("at"))]
        self.train = np.repeat(~np.array(row["held_out"], bool), np.diff(self.begin))
        self.ids = ids[order]
        #: Of the last order: the n-gram at each token, totals and numbers by n-gram, contexts' flags and counts by context.
        self.at, self.totals, self.numbers = self.word_at, totals[order], self.ids[:, None]
        self.word_totals, self.p = self.totals, model.p_word(totals[order])
        self.context, self.heads, self.whole = np.zeros(len(order), np.int64), np.array([model.total]), np.zeros(1, bool)

    def deepen(self) -> None:
        """The distinct n-grams of the next order; the context after the last n-gram's place is the start."""
        gram = np.empty(len(self.at), np.int64)
        gram[1:] = self.at[:-1]
        gram[self.begin[:-1]] = len(self.totals)
        gram <<= 32
        gram |= self.word_at
        gram, first, at = np.unique(gram, return_index=True, return_inverse=True)
        context, self.word, self.lower = (gram >> 32).astype(np.int32), (gram & 0xFFFFFFFF).astype(np.int32), self.at[first]
        at, many = at.astype(np.int32), len(gram)
        del gram, first
        self.heads_below, self.whole_below, self.context_below = self.heads, self.whole, self.context
        self.heads = np.append(self.totals, self.model.starts)
        self.head_numbers = np.vstack([self.numbers, np.zeros((1, self.numbers.shape[1]), np.int64)])
        self.context, self.at, self.many = context, at, many
        key = np.zeros(len(self.heads), U)
        for c in range(self.head_numbers.shape[1]):
            key = mix(key * U(31) + self.head_numbers[:, c].astype(U))
        ways = 1 + self.heads // max(1, self.model.total // HOT)
        self.hot = ways > 1
        salt = mix(self.ids[self.word].astype(U)) % ways[context].astype(U)
        part = (((key >> U(20))[context] + salt) % U(self.model.parts)).astype(np.int64)
        self.order, self.cut = _split(part, self.model.parts)
        part = part[self.order]
        #: Where a context begins in that order.
        self.lead = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (context[self.order][1:] != context[self.order][:-1])]))

    def asks(self, pack: int):
        """A row for each partition that the pack has n-grams of."""
        lead_cut = np.searchsorted(self.lead, self.cut)
        counts, lower_totals = np.bincount(self.at[self.train], minlength=self.many), self.totals[self.lower]
        base = self.heads_below[self.context_below[self.lower]] * 2 + self.whole_below[self.context_below[self.lower]]
        for b in np.flatnonzero(np.diff(self.cut)):
            own, lead = self.order[self.cut[b] : self.cut[b + 1]], self.lead[lead_cut[b] : lead_cut[b + 1]]
            head = self.order[lead]
            context = self.context[head]
            yield _row(
                _SCHEMAS["ask"],
                part=b,
                pack=pack,
                contexts=_dump(self.head_numbers[context].T.ravel()),
                degrees=_dump(np.diff(np.append(lead, self.cut[b + 1]))),
                hot=_dump(self.hot[context].astype(np.int64)),
                below=_dump(base[head]),
                words=_dump(self.ids[self.word[own]]),
                totals=_dump(lower_totals[own]),
                counts=_dump(counts[own]),
            )

    def absorb(self, told: list[dict], order: int, last: bool = False) -> None:
        """Totals, probabilities and contexts of the order that ``deepen`` began, from the partitions' answers; of the last order to be scored, probabilities only."""
        d, model = self.model.d[order - 1], self.model
        totals = np.empty(self.many, np.int64)
        totals[self.order] = _loads(t["totals"] for t in told)
        sums, given = np.zeros((len(self.heads), DISCOUNTED + 1)), np.zeros(len(self.heads), bool)
        lead_cut = np.searchsorted(self.lead, self.cut)
        starts = [lead_cut[t["part"]] for t in told]
        asked = np.concatenate([_load(t["open"]) + s for t, s in zip(told, starts)])
        at = self.context[self.order[self.lead[asked]]]
        sums[at, :DISCOUNTED] = _loads(t["classes"] for t in told).reshape(-1, DISCOUNTED)
        sums[at, DISCOUNTED] = _loads((t["seen"] for t in told), np.float64)
        given[at] = True
        for i in np.flatnonzero(self.hot):
            if (found := model.spread[order - 1].get(tuple(self.head_numbers[i].tolist()))) is not None:
                sums[i], given[i] = found, True
        tokens = np.maximum(1, self.heads)
        whole = given & (sums[:, :DISCOUNTED].sum(axis=1) == 0)
        left = np.where(whole, 1 / (tokens + 1), sums[:, :DISCOUNTED] @ ((1 - d[1 : DISCOUNTED + 1]) * np.arange(1, DISCOUNTED + 1)) / tokens)
        backoff = np.where(self.heads > 0, left / (1 - sums[:, DISCOUNTED]), 1.0)
        kept = np.where(whole, tokens / (tokens + 1), 1.0)
        p, live = backoff[self.context] * self.p[self.lower], np.flatnonzero(totals > 0)
        at, seen = self.context[live], totals[live]
        p[live] = kept[at] * d[np.minimum(seen, DISCOUNTED + 1)] * seen / tokens[at]
        self.p = p
        del self.order, self.lead, self.lower, sums, left, backoff, at, seen, live
        if last:
            return
        # By last word, then context: contexts of the next order that share their shorter context stand together in its rows.
        by_word = np.argsort(self.word.astype(np.int64) << 32 | self.context)
        rank = np.empty(len(by_word), np.int32)
        rank[by_word] = np.arange(len(by_word))
        self.numbers = np.column_stack([self.head_numbers[self.context], self.ids[self.word]])[by_word]
        self.at, self.p, self.context = rank[self.at], self.p[by_word], self.context[by_word]
        self.whole, self.totals = whole, totals[by_word]


def _pack_of(row: dict, model: Model, order: int, last: bool = False) -> Pack:
    """A pack with the answers for all orders up to the given one; the row's answers are used up."""
    p = Pack(row, model)
    for k in range(2, order + 1):
        p.deepen()
        p.absorb(row.pop(f"t{k}"), k, last and k == order)
    return p


def score_documents(docs: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text", order: int = 3) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); held_out: SQL over doc_id, true for documents not learned from."""
    spark = docs.sparkSession
    ws = Workspace(spark, "katz")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = f"packs_{uuid.uuid4().hex}"
    try:
        # Bucketed, so that joins with the answers do not move the packs.
        _packs(rows, f"coalesce({held_out}, false)").write.bucketBy(n, "pack").option("path", f"{ws.root}/packs").saveAsTable(table)
        return _score(spark.table(table), ws, order)
    finally:
        spark.sql(f"drop table if exists {table}")
        ws.drop("packs")


def _score(packs: DataFrame, ws: Workspace, order: int) -> DataFrame:
    size, starts = packs.agg(F.sum("size"), F.sum(F.size(F.filter("held_out", lambda x: ~x)))).first()
    parts = max(64, int(size or 0) // PART_BYTES)
    total = lambda told, many: [told.filter("pack = -1").agg(*[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0.0)) for i in range(many)]).first()[i] for i in range(many)]

    def ask_words(batches):
        for x in _each_row(batches):
            words, counts = _load(x["words"], U), _load(x["counts"])
            by_part, cut = _split(_word_parts(words, parts), parts)
            for b in np.flatnonzero(np.diff(cut)):
                own = by_part[cut[b] : cut[b + 1]]
                yield _row(_SCHEMAS["ask"], part=b, pack=x["pack"], words=_dump(words[own], True), counts=_dump(counts[own]))
        give_back()

    told = [ws.save(packs.select("pack", "words", "counts").mapInArrow(ask_words, _ASK).groupBy("part").applyInArrow(_add_words(parts), _TOLD), "order1")]
    model = Model(parts, int(starts or 0), total(told[0], DISCOUNTED + 3))

    def with_answers() -> DataFrame:
        out = packs.drop("counts", "size")
        for k, t in enumerate(told, 1):
            cols = ["part", "totals", *(["ids"] if k == 1 else ["open", "classes", "seen"])]
            own = t.filter("pack >= 0").groupBy("pack").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(f"t{k}"))
            out = out.join(own, "pack")
        return out

    for k in range(2, order + 1):

        def ask(batches, k=k):
            for x in _each_row(batches):
                p = _pack_of(x, model, k - 1)
                p.deepen()
                yield from p.asks(x["pack"])
                del p
                give_back()

        told.append(ws.save(with_answers().mapInArrow(ask, _ASK).groupBy("part").applyInArrow(_add_grams(k, model.below(k)), _TOLD), f"order{k}"))
        model.d.append(discounts(total(told[-1], DISCOUNTED + 1)))
        # At most HOT contexts.
        hot = told[-1].filter("pack = -2").groupBy("context").agg(*[F.sum(F.col("sums")[i]).alias(f"x{i}") for i in range(DISCOUNTED + 1)])
        model.spread.append({tuple(r.context): np.array(r[1:]) for r in hot.collect()})

    def score(batches):
        for x in _each_row(batches):
            p = _pack_of(x, model, order, last=True)
            begin = p.begin[:-1]
            base = np.log10((p.word_totals + 1) / (model.total + model.kinds + 1))[p.word_at]
            known = (p.word_totals > 0)[p.word_at].astype(np.int64)
            many = len(begin)
            cols = [pa.array(x["doc_id"], pa.int64()), pa.array(x["held_out"], pa.bool_()), pa.array(np.diff(p.begin)), pa.array(np.add.reduceat(known, begin)), pa.array(np.full(many, model.total, np.int64)), pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(np.log10(p.p)[p.at], begin))]
            del p, base, known
            give_back()
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = with_answers().mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = ws.save(out, "scores")
    ws.drop(*(f"order{k}" for k in range(1, order + 1)))
    return out
