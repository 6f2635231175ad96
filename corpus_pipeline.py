"""The corpus pipeline: documents in, sharded training documents out.

Each stage reads what its predecessor kept and returns the columns of documents;
the last adds the shard and the place in it.  Null, empty and blank texts hold nothing
that a stage rejects: they go through all stages, once each, and are sharded by the
one byte that every row counts.  Very long texts are handled whole.  Of equal rows one
stays after the second stage, unless their texts have no words.  Ties are broken by
hashes, then by ids.  Rows without ids are told apart by their texts.  Columns named
like the last stage's results are replaced by these; other columns pass through.  An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillwork.llm import decontaminate, jaccard, mixing, sharding, toxicity
from quillwork.llm.tables import table
from quillwork.plans.materialize import discard, materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that are scored toxic go."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group linked by shingles of five words at 0.8, one document stays."""
    return jaccard.deduplicate(docs, width=5, percent=80)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a window of ten benchmark words go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents as often as the mix of sources takes them, whole."""
    return mixing.compose(docs)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: all documents with shard and slot."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]

#: Toxicity is a trained classifier, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out = materialize(out, f"stage-{name}")
        if i:  # its successor has read it
            discard(docs)
        docs = out
    return docs
