"""From documents to encoded training text: rejected, merged, decontaminated and tokenized, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import common, decontamination, pieces, quality, simhash, toxicity


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; learned from the labels of this stage's documents."""
    return toxicity.reject(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def poor_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as of poor quality go."""
    return quality.reject(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays, wherever else that id stands."""
    return simhash.one_of_each(docs)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows hit a twentieth of the words or more go."""
    return decontamination.without_documents(docs, common.table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns as they are, the ids, the bytes of the text behind each id, and whether decoding gives the text again.

    A new column whose name the documents have already gets underscores behind it.
    """
    own = docs.select(*[common.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text = f"c{docs.columns.index('text')}"
    out = pieces.encoded(own, text=text, verify=True)
    new = [F.col(c).alias(common.unused(c, docs.columns)) for c in ("ids", "begins", "ends", "round_trip")]
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], *new)


STAGES = [("toxicity", toxic_out), ("quality", poor_out), ("near_duplicates", copies_out), ("decontamination", contaminated_out), ("encoding", encoded)]

#: Two stages learn their decisions from labels, which SQL can't express; tests hold run() against the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
