"""Context and prompts for retrieved documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import fill_template, newline_to_blank

# Layout of one document and the line between two of them.
DOCUMENT = "Document Name: {name}\nContent: {content}"
SEPARATOR = "\n\n---\n\n"

PROMPT = (
    "Answer the question below from the context only. Name the documents used and quote the "
    "passages that support the answer.\n\nQuestion: {query}\n\nContext:\n{context}\n"
)


def with_content(hits: DataFrame, documents: DataFrame, id_col: str, doc_id: str, content: str) -> DataFrame:
    """Put the content to retrieved ids; a hit without a document keeps its place, with null content.

    ``hits`` should be a stored table (``session.settle``): while it is small,
    Catalyst broadcasts it by its size, so the documents are scanned once and
    their texts never shuffled; a large one becomes a shuffle join.
    """
    texts = documents.select(F.col(doc_id).alias("__doc"), F.col(content).alias("content"))
    wanted = hits.select(F.col(id_col).alias("__doc")).distinct()
    found = texts.join(wanted, "__doc", "left_semi")
    return hits.join(found, F.col(id_col) == F.col("__doc"), "left").drop("__doc")


def context(hits: DataFrame, question_id: str, name: str, rank: str = "rank", content: str = "content") -> DataFrame:
    """One context text per question: documents in rank order (k per question), those without content left out."""
    piece = fill_template(DOCUMENT, {"name": F.col(name).cast("string"), "content": F.col(content)})
    return hits.groupBy(question_id).agg(
        F.concat_ws(
            SEPARATOR,
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col(rank), piece.alias("text")))), lambda p: p.getField("text")
            ),
        ).alias("context")
    )


def prompts(contexts: DataFrame, questions: DataFrame, question_id: str, query: str, template: str = PROMPT) -> DataFrame:
    """Fill the prompt template with each question and its context, which is empty for a question without hits."""
    values = {"query": newline_to_blank(F.col(query)), "context": F.coalesce("context", F.lit(""))}
    return questions.select(question_id, query).join(contexts, question_id, "left").select(
        question_id, fill_template(template, values).alias("prompt")
    )
