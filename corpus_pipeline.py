"""A corpus pipeline of five stages over documents: toxicity, line dedup, near-duplicates, decontamination, BPE.

Each stage is written as Parquet and read again, so a lost executor costs a task, never a stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetframe.llm import decontam, jaccard, lines, toxicity
from sheetframe.llm.common import drop_folder, fresh, shared_dir
from sheetframe.llm.queries import bpe_digests, table


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5; the labelled rows outside the held-out fifth teach the lexicon.

    Null and empty texts have no evidence and stay, as do rows without an id. Without labels, the fixed words decide alone.
    """
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "toxicity_score")
    return toxicity.score(docs, lexicon, to=score).where(F.col(score) < 0.5).select(*docs.columns)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the lines that they keep as their text, and its length where there is an n_chars.

    Null texts become empty. Rows without an id lose nothing. Columns named like the operator's counts stay as they are.
    """
    marked = {c: fresh(docs, f"own_{c}") for c in ("n_lines", "n_dropped") if c in docs.columns}
    out = lines.dedup_lines(docs.withColumnsRenamed(marked))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.drop("n_lines", "n_dropped").withColumnsRenamed({v: k for k, v in marked.items()}).select(*docs.columns)


#: Near-duplicates of the pipeline: words of a shingle, and percent of all shingles that two texts must share. (op4's own are 3 and 90.)
NEAR_WORDS, NEAR_PERCENT = 5, 80


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts, the document with the smallest id.

    Rows of one id are one document: they stay or go together, and stay if any of their texts leads its component. Rows
    without an id are similar to nothing and stay.
    """
    groups = jaccard.similarity_components(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)
    leads = groups.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias("leads"))
    gone = leads.where("not leads").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark was found. Null and empty texts hold none; rows without an id stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and of the decoded bytes; a null text is an empty one."""
    return bpe_digests(docs)


STAGES = [
    ("toxicity", clean_language),
    ("line_dedup", without_shared_lines),
    ("jaccard_join", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("byte_bpe", encoded),
]

#: SQL can express neither the learned lexicon nor the encoder; tests/llm hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        done.write.parquet(f"{place}/{name}")
        docs = spark.read.schema(done.schema).parquet(f"{place}/{name}")
        if before:
            drop_folder(spark, f"{place}/{before}")
        before = name
    return docs
