"""Extractive summaries: the best lines of each document by mean TF-IDF, or its sentences until enough is said."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.common import least_common
from millrace.session import settle

WORD = r"[\p{L}\p{N}]+"
HOT_SHARE = 100_000  # a common word stands in at least one document of so many
MAX_HOT = 200_000  # words that may be broadcast
ROWS = 250  # documents scored at once


def line_words(text: str) -> Column:
    """The words of each line of a text, line by line."""
    return F.transform(F.split(text, "\n"), lambda line: F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0)))


def document_words(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, total, word, line_no, k, n, first): the words of each line, for ids that stand in several rows.

    ``k`` counts a word in its line, ``n`` in its document, ``total`` all words
    of the row; ``first`` marks one row per document and word. Words are spread
    by document id and word, which the grouping and the window contain.
    """
    counted = documents.select(doc_id, text, F.size(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("total"))
    lines = counted.select(doc_id, "total", F.posexplode(line_words(text)).alias("line_no", "words"))
    words = lines.select(doc_id, "total", "line_no", F.explode("words").alias("word")).repartition(doc_id, "word")
    same = Window.partitionBy(doc_id, "word")
    return (
        words.groupBy(doc_id, "total", "word", "line_no")
        .agg(F.count("*").alias("k"))
        .withColumns({"n": F.sum("k").over(same), "first": F.col("line_no") == F.min("line_no").over(same)})
    )


def document_frequency(words: DataFrame) -> DataFrame:
    """Number of documents per word."""
    return words.groupBy("word").agg(F.count_if("first").alias("df"))


def distinct_words(documents: DataFrame, text: str = "text") -> DataFrame:
    """The columns of the documents but the text, and a row for each of a document's distinct words."""
    rest = [c for c in documents.columns if c != text]
    return documents.select(*rest, F.explode(F.array_distinct(F.flatten(line_words(text)))).alias("word"))


def with_frequency(words: DataFrame, frequency: DataFrame, least: int) -> DataFrame:
    """Join the words of documents with their document frequency.

    The vocabulary grows with the data, so it is joined by shuffle, but without
    its common words, which would be hot keys; these are broadcast.
    """
    hot = frequency.filter(F.col("df") >= least)
    cold = frequency.filter(F.col("df") < least)
    looked_up = words.join(F.broadcast(hot), "word", "left")
    common = looked_up.filter("df is not null")
    others = looked_up.filter("df is null").drop("df").join(cold, "word")
    return common.unionByName(others)


def line_scores(words: DataFrame, frequency: DataFrame, least: int, n_documents: int, doc_id: str = "doc_id") -> DataFrame:
    """Mean TF-IDF of the words of each line.

    tf is the share of a word in its document, idf is ln((1 + N) / (1 + df)).
    """
    weight = F.col("n") / F.col("total") * F.log((1 + F.lit(n_documents)) / (1 + F.col("df")))
    weighted = with_frequency(words, frequency, least).select(doc_id, "line_no", "k", weight.alias("w"))
    mean = F.sum(F.col("k") * F.col("w")) / F.sum("k")
    # rounded so that equal lines tie whatever the order of summation
    return weighted.groupBy(doc_id, "line_no").agg(F.round(mean, 9).alias("score"))


def _score(hot: Broadcast, n_documents: int):
    """The same mean for every line of whole documents, word by word; a line without words has a null."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_words, hot_df = hot.value
        for rows in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            lines = rows.column(2).flatten()
            tokens = lines.flatten().dictionary_encode()
            n_lines, n_words = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (rows.column(2), lines))
            vocabulary, codes = tokens.dictionary, tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            df = np.concatenate([hot_df, rows.column(4).flatten().to_numpy(zero_copy_only=False)])
            known = pa.concat_arrays([hot_words, rows.column(3).flatten().cast(hot_words.type)])
            df = df[pc.index_in(vocabulary.cast(hot_words.type), known).to_numpy(zero_copy_only=False).astype(np.int64)]
            doc = np.repeat(np.repeat(np.arange(rows.num_rows), n_lines), n_words)
            _, place, n = np.unique(doc * len(vocabulary) + codes, return_inverse=True, return_counts=True)
            total = np.bincount(doc, minlength=rows.num_rows)
            weight = n[place] / total[doc] * np.log((1 + n_documents) / (1 + df))[codes]
            sums = np.bincount(np.repeat(np.arange(len(lines)), n_words), weight, len(lines))
            means = pa.array(sums / np.maximum(n_words, 1), pa.float64(), mask=n_words == 0)
            made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_lines)]), pa.int32()), means)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), made], names=[*rows.schema.names[:2], "scores"])
        pa.default_memory_pool().release_unused()  # workers live on

    return score


def _best_in_row(documents: DataFrame, frequency: DataFrame, least: int, n_documents: int, n_lines: int, doc_id: str, text: str) -> DataFrame:
    """(doc, text, numbers) of documents whose id stands in one row: each is scored as a whole.

    Common words' frequencies are sent to the tasks. The others are looked up
    by shuffle, a row per document and word, and come to their document as a list.
    """
    spark = documents.sparkSession
    common = frequency.filter(F.col("df") >= least).select("word", "df").toArrow().combine_chunks()
    hot_words, hot_df = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in common.columns)
    hot = spark.sparkContext.broadcast((hot_words.cast(pa.string()), hot_df.to_numpy()))
    rare = frequency.filter(F.col("df") < least)
    rows = documents.select(doc_id, text)
    if rare.isEmpty():
        rows = rows.withColumns({"rare": F.array().cast("array<string>"), "rare_df": F.array().cast("array<bigint>")})
    else:
        asked = distinct_words(rows.filter(F.col(doc_id).isNotNull()), text)
        asked = asked.join(F.broadcast(frequency.filter(F.col("df") >= least).select("word")), "word", "left_anti")
        listed = asked.join(rare, "word").groupBy(doc_id).agg(F.collect_list(F.struct("word", "df")).alias("rare"))
        listed = listed.select(doc_id, F.col("rare.word").alias("rare"), F.col("rare.df").alias("rare_df"))
        rows = rows.join(listed.hint("shuffle_hash"), doc_id, "left")
    words = F.when(F.col(doc_id).isNotNull(), line_words(text))  # a row without id is not summed up
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    scored = rows.select(doc_id, text, words.alias("words"), "rare", "rare_df").mapInArrow(
        _score(hot, n_documents), f"`{doc_id}` {kinds[doc_id]}, `{text}` string, scores array<double>"
    )
    # rounded so that equal lines tie whatever the order of summation
    places = F.transform("scores", lambda s, i: F.struct((-F.round(s, 9)).alias("score"), i.alias("line_no")))
    best = F.slice(F.array_sort(F.filter(places, lambda p: p["score"].isNotNull())), 1, n_lines)
    return scored.select(doc_id, text, F.array_sort(F.transform(best, lambda p: p["line_no"])).alias("numbers"))


def _best_of_rows(
    documents: DataFrame, words: DataFrame, frequency: DataFrame, least: int, n_documents: int, n_lines: int, doc_id: str, text: str
) -> DataFrame:
    """(doc, text, numbers) of documents whose id stands in several rows: their words count together."""
    best = Window.partitionBy(doc_id).orderBy(F.desc("score"), "line_no")
    chosen = (
        line_scores(words, frequency, least, n_documents, doc_id)
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= n_lines)
        .groupBy(doc_id)
        .agg(F.array_sort(F.collect_list("line_no")).alias("numbers"))
    )
    return documents.select(doc_id, text).join(chosen, doc_id, "left").select(doc_id, text, "numbers")


def extractive_summary(
    documents: DataFrame, n_lines: int = 10, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document its ``n_lines`` best lines, in text order, as bullet points.

    A document is scored where its text lies; only distinct words are counted
    across documents. Rows that share an id are one document: their words are
    grouped. A document without words, or without a text, has no lines and an
    empty summary.
    """
    n_documents = documents.count()
    repeated = settle(documents.groupBy(F.col(doc_id).alias("__id")).agg(F.count("*").alias("__n")).filter("__n > 1").select("__id"), "repeated-ids")
    once, shared, words = documents.select(doc_id, text), None, None
    if not repeated.isEmpty():
        same = F.col(doc_id).eqNullSafe(F.col("__id"))
        once, shared = once.join(repeated, same, "left_anti"), once.join(repeated, same, "left_semi")
        words = settle(document_words(shared, doc_id, text), "document-words")
    frequency = distinct_words(once, text).groupBy("word").agg(F.count("*").alias("df"))
    if words is not None:
        frequency = frequency.unionByName(document_frequency(words)).groupBy("word").agg(F.sum("df").alias("df"))
    frequency = settle(frequency, "word-frequency")
    least = least_common(frequency, "df", n_documents // HOT_SHARE, MAX_HOT)
    chosen = _best_in_row(once, frequency, least, n_documents, n_lines, doc_id, text)
    if words is not None:
        chosen = chosen.unionByName(_best_of_rows(shared, words, frequency, least, n_documents, n_lines, doc_id, text))
    lines = F.split(F.col(text), "\n")
    bullets = F.transform(F.col("numbers"), lambda i: F.concat(F.lit("- "), F.get(lines, i)))
    count = F.when(F.col("numbers").isNull(), 0).otherwise(F.size("numbers"))
    return chosen.select(doc_id, count.alias("n_lines"), F.concat_ws("\n", bullets).alias("summary"))


# -- without a number of points ------------------------------------------------------------

#: A sentence ends with a mark in front of white space, or with its line.
SENTENCE_END = re.compile(r"[.!?](?=\s)|\n")
TOKEN = re.compile(r"[^\W_]+")
MAX_WORDS = 180
ADDED = "n_sentences int, n_words int, summary string"


def sentences_of(text: str) -> list[str]:
    cuts = [0, *(m.end() for m in SENTENCE_END.finditer(text)), len(text)]
    found = (text[a:b].strip() for a, b in zip(cuts, cuts[1:]))
    return [x for x in found if TOKEN.search(x)]


def chosen_sentences(words: list[list[str]], max_words: int) -> list[int]:
    """Which sentences to keep, by number: those of frequent words first, none that says again what has been said.

    A word weighs its share of the text. The sentence of greatest mean weight
    is taken (ties go to the earlier one), and the weights of its words are
    squared, so that the next one tells something else. A sentence that would
    exceed ``max_words`` is passed over; the first one always fits.
    """
    total = sum(map(len, words))
    weight = {w: n / total for w, n in Counter(w for s in words for w in s).items()}
    holds: dict[str, list[int]] = {}
    for i, s in enumerate(words):
        for w in set(s):
            holds.setdefault(w, []).append(i)
    count = [Counter(s) for s in words]
    mean = [sum(n * weight[w] for w, n in sorted(c.items())) / len(s) for c, s in zip(count, words)]
    left, room, out = set(range(len(words))), max_words, []
    while left:
        best = min(left, key=lambda i: (-round(mean[i], 12), i))
        out.append(best)
        room -= len(words[best])
        left = {i for i in left if i != best and len(words[i]) <= room}  # so there are no more turns than words
        touched = {i for w in count[best] for i in holds[w] if i in left}
        for w in count[best]:
            weight[w] *= weight[w]
        for i in touched:
            mean[i] = sum(n * weight[w] for w, n in sorted(count[i].items())) / len(words[i])
    return sorted(out)


def _free(max_words: int):
    def free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = sentences_of(text or "")
                words = [TOKEN.findall(x.lower()) for x in found]
                kept = chosen_sentences(words, max_words) if found else []
                rows.append((len(kept), sum(len(words[i]) for i in kept), " ".join(found[i] for i in kept)))
            made = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, (pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=[batch.schema.names[0], "n_sentences", "n_words", "summary"])

    return free


def free_summary(documents: DataFrame, max_words: int = MAX_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the sentences that sum it up, in text order, in at most ``max_words`` words (unless the first is longer).

    Every document is summed up where it lies; nothing shuffles. A null text,
    or one without words, has no sentences and an empty summary.
    """
    rows = documents.select(doc_id, text)
    kind = rows.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(_free(max_words), f"`{doc_id}` {kind}, {ADDED}")
