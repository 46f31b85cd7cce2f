"""Queries of the dealt operators over whole tables: each derives its digest columns from the operator's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatia.llm.work import Workspace


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbatia.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2).drop("text_key")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbatia.llm.html_text import extract_text

    rows = extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbatia.llm.secrets import scan_secrets, secret_digest

    return secret_digest(scan_secrets(_table(spark, sf_dir, "documents")))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbatia.llm.repeats import remove_repeats, repeat_digest

    return repeat_digest(remove_repeats(_table(spark, sf_dir, "documents")))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbatia.llm.embeddings import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbatia.llm.pieces import encode_pieces

    rows = encode_pieces(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbatia.llm.katz import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), "crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbatia.llm.language import identify, learn_languages

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    model = learn_languages(docs.filter("not held_out"))
    rows = identify(docs.select("doc_id", "held_out", "text"), model)
    return rows.select("doc_id", "held_out", "lang_pred.lang", "lang_pred.score").withColumnRenamed("lang", "lang_pred")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbatia.llm.token_files import read_tokens, token_digest, write_tokens

    ws = Workspace(spark, "token_files")
    files = write_tokens(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), 2, ws)
    return token_digest(read_tokens(files))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbatia.llm.decontaminate import contamination, decontaminate

    return contamination(decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbatia.llm.spelling import count_words, misread, runs, spelling_groups

    found = runs(_table(spark, sf_dir, "documents"))
    words = count_words(found.select(misread(F.col("run"), F.col("doc_id")).alias("word")))
    return spelling_groups(words, Workspace(spark, "spelling")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from verbatia.llm.byte_bpe import encode_bytes

    rows = encode_bytes(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verbatia.llm.ranked_search import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_key")


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_html_text, op3_secrets, op4_repeats, op5_embeddings, op6_pieces, op7_katz, op8_language, op9_token_files, op10_decontaminate, op11_spelling, op12_byte_bpe, op13_ranked_search)}
TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL: dict[str, str] = {
    "op13_ranked_search": f"""
with terms as (select doc_id, unnest({TERMS}) as term from documents),
asked as (select distinct item_id, unnest({TERMS}) as term from benchmark),
lengths as (select doc_id, count(*) as n from terms group by doc_id),
totals as (select count(*) as docs, cast(sum(n) as bigint) as l from lengths),
occurrences as (select doc_id, term, count(*) as tf from terms where term in (select term from asked) group by doc_id, term),
weights as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from occurrences, totals group by term, docs),
scores as (
  select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // l)))) as bigint) as score
  from asked join weights using (term) join occurrences using (term) join lengths using (doc_id), totals
  group by item_id, doc_id
),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from scores where score > 0)
select item_id, cast(place as integer) as rank, doc_id, score from ranked where place <= 50
"""
}
