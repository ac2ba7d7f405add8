"""A corpus pipeline of training-data operators: each stage works on what the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what each returns as
Parquet and reads it again as the next one's documents. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import linededup, packing, quality, semantic, setjoin
from palimpsest.llm._util import discard, fresh, materialize
from palimpsest.llm.queries import TOKENIZER, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model, score = quality.fit(docs, table(spark, sf_dir, "labels")), fresh(docs, "score")
    return quality.with_score(docs, model, score).where(F.col(score) >= quality.CUT).drop(score)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their duplicate lines; those of which no line is left go."""
    n_lines, n_dropped = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    out = linededup.dedup(docs, n_lines, n_dropped, least=1)
    return out.where((F.col(n_dropped) == 0) | F.col("text").rlike("[^ \\t\\n-\\r]")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: that of the smallest doc_id.

    Rows without doc_id stay, as nothing can tell them apart from the one to keep.
    """
    found = setjoin.jaccard_components(docs)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    found = semantic.find(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: Learned scores, MinHash candidates and the packing itself are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage returned is deleted when the next one's is written."""
    docs, done = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
        if done is not None:
            discard(done)
        done = docs
    return docs
