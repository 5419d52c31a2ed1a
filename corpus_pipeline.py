"""Corpus pipeline: toxicity, n-gram Jaccard join, decontamination, mixing, token output.

Every stage takes the documents its predecessor kept and returns documents; the
last writes token files and returns one row for each document it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm import decontaminate, mixing, ngram_join, tokens, toxicity
from trailspark.llm._store import materialize, read, settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go; null and empty texts, null ids and repeated rows are scored like any."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=COLUMNS).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents, the one of smallest id stays; documents without words, or without an id, stay."""
    found = ngram_join.jaccard_components(docs).where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    kept = docs.join(found, F.col("doc_id") == F.col("gone"), "left_anti")
    repeated = materialize(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("r")), "repeated")
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    # rows of one id are one document: one of them stays
    several = kept.join(repeated, F.col("doc_id") == F.col("r"), "left_semi")
    first = several.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("first")).select("doc_id", "first.*")
    return kept.join(repeated, F.col("doc_id") == F.col("r"), "left_anti").select(*COLUMNS).unionByName(first)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go, every copy of them; null and empty texts stay."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"), COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without words stay once, as they use no budget."""
    mixed = mixing.mix(docs, carry=("text", "lang", "n_chars"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("times"))
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back; a null or empty text is the end id alone, null ids come first, repeated rows stand side by side."""
    return tokens.read_back(tokens.write(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_tokens),
]

#: Toxicity is a learned model, and tokens come from a tokenizer: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{n}")
        settle(spark)
    return docs
