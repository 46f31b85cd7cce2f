"""From raw documents to token ids: language, near copies, benchmark passages, secrets, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next one reads
it. All but the last return the columns of ``documents``. Rows that a stage removes are found by id and
text, so rows that repeat an id are judged on their own text.

Cases: rows with a null text have no letter and go in the first stage. Rows with a null id are never
taken for near copies. Of rows that are equal in id and text one stays. Extra columns, whatever their names,
pass through unchanged up to the last stage, which returns its own columns only. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatia.llm.decontaminate import contaminated, decontaminate
from verbatia.llm.language import UNKNOWN, identify, learn_languages
from verbatia.llm.near_dedup import near_duplicates
from verbatia.llm.pieces import encode_pieces
from verbatia.llm.secrets import redact_secrets
from verbatia.llm.work import Workspace, restrict, unused

MODEL = "piece_bpe_32k.model"


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """Rows of docs whose (doc_id, text) is not among the given (doc_id, text_key)."""
    keys = Workspace(docs.sparkSession, name).save(gone.select("doc_id", "text_key").distinct(), "gone")
    key = unused(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    return restrict(keyed, keys.withColumnRenamed("text_key", key), ["doc_id", key], "left_anti").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of no language go; the others get the language found."""
    name = unused(docs, "found")
    found = identify(docs, learn_languages(docs), out=name)
    return found.filter(F.col(f"{name}.lang") != UNKNOWN).withColumn("lang", F.col(f"{name}.lang")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8)."""
    found = near_duplicates(docs)
    left = _without(docs, found.filter("not kept and doc_id is not null"), "near_copies")
    keys = Workspace(spark, "repeated_rows").save(found.filter("doc_id is not null").groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id", "text_key"), "keys")
    if keys.isEmpty():
        return left
    key = unused(docs, "text_key")
    keyed, keys = left.withColumn(key, F.xxhash64("text")), keys.withColumnRenamed("text_key", key)
    once = restrict(keyed, keys, ["doc_id", key]).dropDuplicates(["doc_id", key])
    return restrict(keyed, keys, ["doc_id", key], "left_anti").unionByName(once).select(docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.filter(contaminated()), "contaminated")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets of all layers are masked in the text."""
    masked = redact_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with its language and source."""
    import public_tokenizers

    coded = encode_pieces(docs, public_tokenizers.path(MODEL), keep=("lang", "source", "n_chars"))
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("secrets", secrets),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over all documents, each one's rows written for the next."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
