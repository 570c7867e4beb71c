"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.llm import ann, bpe, conversations, exact_dedup, langid, licenses, line_dedup, mixing, ngram_join, packing, pii, secrets, spelling
from churnlens.llm.common import documents, prepare


def op1_language_id(spark, sf_dir):
    """Fit on the labelled documents that are not held out, predict all."""
    prepare(spark)
    docs = documents(spark, sf_dir)
    held_out = langid.held_out("doc_id")
    model = langid.fit(docs.where(~held_out))
    got = langid.identify(docs, model, into="_lid")
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"),
                      F.col("_lid.lang").alias("lang_pred"), F.col("_lid.score").alias("score"),
                      F.col("_lid.rejected").alias("rejected"))


def op2_exact_dedup(spark, sf_dir):
    """All documents as one batch against a new, empty index."""
    prepare(spark)
    return exact_dedup.exact_dedup(documents(spark, sf_dir), exact_dedup.DigestIndex(spark))


def op3_find_pii(spark, sf_dir):
    prepare(spark)
    return pii.find_pii(documents(spark, sf_dir))


def op4_mix_sources(spark, sf_dir):
    prepare(spark)
    return mixing.taken_words(mixing.plan_mix(documents(spark, sf_dir)))


def op5_ngram_jaccard_join(spark, sf_dir):
    """Groups of documents linked by 3-word shingle sets of similarity 0.9 or more."""
    prepare(spark)
    return ngram_join.ngram_components(documents(spark, sf_dir), words=3, similarity=(9, 10))


def op6_best_fit_packing(spark, sf_dir):
    """All documents into sequences of 1024 ids of the public byte-level BPE."""
    import public_tokenizers

    prepare(spark)
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_line_dedup(spark, sf_dir):
    """Recurring line templates dropped from all documents."""
    prepare(spark)
    got = line_dedup.clean_lines(documents(spark, sf_dir))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("clean_text", 256).alias("clean_sha256"))


def op8_nearest_neighbours(spark, sf_dir):
    """Five nearest of all rows for every row whose id is divisible by 50."""
    prepare(spark)
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op9_secret_scan(spark, sf_dir):
    prepare(spark)
    return secrets.scan_secrets(documents(spark, sf_dir))


def op10_license_scan(spark, sf_dir):
    prepare(spark)
    return licenses.scan_licenses(documents(spark, sf_dir))


def op11_bpe_codec(spark, sf_dir):
    """Ids of all documents by the public word BPE, and their decoded texts, as digests."""
    import public_tokenizers

    prepare(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = bpe.decode(bpe.encode(documents(spark, sf_dir), path), path)
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_conversation_repair(spark, sf_dir):
    """All conversations, damaged by the fixed rule and repaired."""
    prepare(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.report(conversations.damaged(rows), rows)


def op13_spelling_variants(spark, sf_dir):
    """Words of all documents with the commoner spelling each is a variant of."""
    prepare(spark)
    return spelling.variants(spelling.vocabulary(documents(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_exact_dedup, op3_find_pii, op4_mix_sources, op5_ngram_jaccard_join,
                                  op6_best_fit_packing, op7_line_dedup, op8_nearest_neighbours, op9_secret_scan, op10_license_scan, op11_bpe_codec,
                                  op12_conversation_repair, op13_spelling_variants)}

SQL = {"op2_exact_dedup": exact_dedup.ORACLE, "op5_ngram_jaccard_join": ngram_join.ORACLE,
       "op7_line_dedup": line_dedup.ORACLE}
