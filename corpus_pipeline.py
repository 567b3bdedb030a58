"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's ``docs``. All but the last keep
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, neardup, packing, quality, substring
from millrace.llm.queries import PACK_END, PACK_VOCABULARY
from millrace.llm.tokens import vocabulary
from millrace.session import settle
from millrace.sources.tables import table


def inner_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows under names that clash with nothing a stage adds, and those names."""
    inner = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(inner), inner


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of ``docs`` that are not held out.

    A null or empty text is scored as a text without words. Rows without id, or
    with one that repeats, are each judged by their own text.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(docs.select("doc_id", "text").join(labels, "doc_id").filter(~quality.held_out()))
    rows, inner = inner_names(docs)
    kept = quality.score(rows, model, text=inner["text"]).filter(F.col("score") >= 0.5)
    return kept.select(*[F.col(inner[c]).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id.

    Documents without words or without id stay. Rows that share an id stay or go together.
    """
    return neardup.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a text that loses nothing stays as it is, a null text becomes an empty one.

    Every document stays, if without words. Of equal passages that of the least
    id stays; rows without id count as later than all others, and rows of one
    id never take words off each other.
    """
    rows, inner = inner_names(docs)
    kept = substring.remove_repeats(rows, inner["text"], inner["doc_id"], keep_layout=True)
    made = {"n_chars": F.length(inner["text"]).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return kept.select(*[made.get(c, F.col(inner[c])).alias(c) for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of a benchmark item go. Null and empty texts, and repeated rows, are judged row by row."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences, with their token ids. A null or empty text is its end id alone."""
    return packing.pack(docs, vocabulary(PACK_VOCABULARY), PACK_END)


STAGES = [
    ("quality", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Learned scores and the tokenizer cannot be said in SQL; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each settled in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
