"""The corpus pipeline: each stage works on all that the one before has kept.

toxicity drops documents scored 0.5 or more; near_dedup keeps the document with the least doc_id of each class;
decontaminate drops documents that hold a window of a benchmark item; pii replaces entities in the texts; bpe encodes.
All but the last return the columns of documents, whole rows and clean texts unchanged. A stage takes any (also an empty)
table with these columns; null texts pass the filters and have no tokens.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from nightflux.llm import bpe, common, decontaminate, minhash_dedup, pii, toxicity


def toxicity_stage(spark, docs, sf_dir: str):
    scored = toxicity.score(docs, toxicity.trained(spark, sf_dir), "__toxicity")
    return scored.filter("__toxicity < 0.5").select(docs.columns)


def near_dedup_stage(spark, docs, sf_dir: str):
    return minhash_dedup.one_of_each(docs).select(docs.columns)


def decontaminate_stage(spark, docs, sf_dir: str):
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark")).select(docs.columns)


def pii_stage(spark, docs, sf_dir: str):
    """n_chars follows the text. The key is that of the session (see pii.session_key)."""
    done = pii.replace(docs, pii.session_key(spark), column="__entities").select(docs.columns)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def bpe_stage(spark, docs, sf_dir: str):
    """doc_id, n_tokens, ids as little-endian unsigned 32-bit numbers, and the digests of ids and decoded text."""
    encoded = bpe.encode(docs, decoded=True)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """All stages over documents; each result is written and read again before the next stage."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
