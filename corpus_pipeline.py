"""Corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. The temporary
tables of a stage are deleted when the next one starts, since its result has
been written by then.

Rows without an id stay documents: near dedup names them by a hash of their
text. Rows of one id are decided together there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import common, exact_dedup, langid, mixing, ngram_join, packing
from churnlens.session import ensure_checkpoint_dir

_done: list[str] = []  # temporary tables of the stage before


def language_id(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents in a known language: those whose nearest centroid is too far, or that have no letter, go."""
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    found = common.fresh(docs, "_language")
    return langid.identify(docs, model, into=found).where(~F.col(f"{found}.rejected")).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each group equal without white space: the longest, then the smallest id."""
    index = exact_dedup.DigestIndex(spark)
    decisions = exact_dedup.exact_dedup(docs, index)
    out = exact_dedup.kept_documents(docs, decisions)
    index.drop()
    return out


def near(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each group linked by 5-word shingles of similarity 0.8 or more: the smallest id."""
    key = common.fresh(docs, "_key")
    named = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"),
                                            -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 62))))
    groups = ngram_join.ngram_components(named, ngram_join.WORDS, ngram_join.SIMILARITY, id_col=key)
    with common.shuffles_freed(spark):
        keep = common.stage(groups.where("doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct(), "keep")
    return named.join(keep, named[key] == F.col("_keep"), "left_semi").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Words of each source towards its target weight; n_chars follows the text."""
    out = mixing.mixed_documents(docs, mixing.plan_mix(docs))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pieces of at most 1024 ids, packed into sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _step(k: int, f):
    def step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.prepare(spark)
        common.small_batches(spark)
        if k:
            common.release(spark, _done)
        before = set(common.staged())
        out = f(spark, docs)
        _done[:] = [p for p in common.staged() if p not in before]
        return out

    step.__doc__ = f.__doc__
    return step


STAGES = [(name, _step(k, f)) for k, (name, f) in enumerate((
    ("language_id", language_id), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("mix_sources", mixed),
    ("best_fit_packing", packed)))]

#: No stage but the second can be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage's result but the last is written to the shared folder."""
    common.prepare(spark)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = common.documents(spark, sf_dir)
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
