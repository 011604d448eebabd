"""A corpus pipeline over `documents`: each stage is one of the operators, applied to all its predecessor kept."""

from tablejury.llm import near_dedup, packing, pii, quality
from tablejury.session import shared_folder


def good(spark, docs, sf_dir):
    """Quality classifier: documents scored below one half go. It learns from `labels` outside the held-out fold."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark, docs, sf_dir):
    """MinHash near-dedup: of each component of near-duplicates the smallest doc_id stays."""
    return near_dedup.deduplicated(docs)


def private(spark, docs, sf_dir):
    """PII: personal data and the terms that reveal it are replaced in the texts."""
    return pii.sanitised(docs)


def packed(spark, docs, sf_dir):
    """Packing: one row per piece of the texts in fixed windows."""
    return packing.pack_digest(packing.pack(docs))


STAGES = [("quality", good), ("near-dedup", distinct), ("pii", private), ("packing", packed)]

ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to `documents`; each stage's result is written and read back before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
