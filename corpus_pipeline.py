"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Toxic documents go, one document of each near-duplicate class stays, documents that hold a benchmark item go, personal
data is replaced by its kind, and the texts are encoded. All stages but the last keep the columns of ``documents``.
Rows are judged by their own texts, also where they share a doc_id; near copies of rows without one stay. Empty tables
give empty ones, null texts stay null up to the last stage, where they have no ids.
"""

from pyspark.sql import functions as F

from dotloom.llm import decontam, jaccard, pii, spiece, toxicity
from dotloom.llm.common import stored


def drop_toxic(spark, docs, sf_dir):
    """Documents with a toxicity score below one half."""
    return toxicity.accepted(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark, docs, sf_dir):
    """One row, that with the least id, of each near-duplicate class."""
    return jaccard.first_of_each(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents without a stretch that matches a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_private(spark, docs, sf_dir):
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark, docs, sf_dir):
    """Token ids of each text, and the digest of what they decode to."""
    return spiece.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_private),
    ("sentencepiece", encode),
]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies STAGES to ``documents``."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        now = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if last:
            last.drop()
        docs, last = now.df, now
    return docs
