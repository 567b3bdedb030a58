"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions alone.

A sketch is the ``SIZE`` least distinct hashes (48 bits) of a text's word
shingles, ascending. Sketches of parts merge to the sketch of the whole; two
of them estimate resemblance and containment, one the number of distinct
shingles. A text of fewer words than a shingle is one shingle; a null or
empty text has the empty sketch. Equal texts have equal sketches. Two empty
sketches are alike (1.0), an empty and another are not (0.0).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, SHINGLE, BITS = 128, 5, 48
LOWEST = -(1 << 63)


def _word_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def _sketch_of_hashes(column: str, size: int, shingle: int) -> Column:
    """From the words' hashes, in a column of their own so that each is made once."""
    h = F.col(column)
    starts = F.sequence(F.lit(0), F.greatest(F.size(h) - shingle, F.lit(0)))
    at = lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + k) for k in range(shingle)]), 64 - BITS)
    least = F.slice(F.sort_array(F.array_distinct(F.transform(starts, at))), 1, size)
    return F.when(F.size(h) > 0, least).otherwise(F.array().cast("array<bigint>"))


def with_sketches(df: DataFrame, texts: dict[str, str], size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """Add the sketch of each text column: ``texts`` has new column: text column."""
    hashes = {f"__hashes_{name}": _word_hashes(F.col(text)) for name, text in texts.items()}
    out = df.withColumns(hashes).withColumns({name: _sketch_of_hashes(f"__hashes_{name}", size, shingle) for name in texts})
    return out.drop(*hashes)


def union(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of both sets together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of the union that both have: of the union's sketch, what is in both."""
    both = union(a, b, size)
    alike = F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(alike)


def distinct_count(a: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact while the sketch is not full."""
    full = F.lit((size - 1) * float(1 << BITS)) / F.element_at(a, -1)
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise(full)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of the first set that the second has, at most 1."""
    shared = resemblance(a, b, size) * distinct_count(union(a, b, size), size)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, size)))


def to_text(a: Column) -> Column:
    """A sketch as text: six bytes a hash, in base 64."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), BITS // 4, "0")), "")))


def from_text(text: Column) -> Column:
    digits = F.regexp_extract_all(F.hex(F.unbase64(text)), F.lit(f"(.{{{BITS // 4}}})"), F.lit(1))
    return F.transform(digits, lambda p: F.conv(p, 16, 10).cast("bigint"))


def merge(sketches: DataFrame, key: str, column: str, size: int = SIZE) -> DataFrame:
    """One sketch for each key from those of its parts.

    The hashes go through a limit per key before and after the shuffle, so a
    key with very many parts sends ``size`` hashes a task.
    """
    hashes = sketches.select(key, F.explode(column).alias("h")).distinct()
    kept = hashes.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("h"))).filter(F.col("r") <= size)
    some = kept.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(column))
    keys = sketches.select(F.col(key).alias("__key")).distinct()
    joined = keys.join(some, F.col("__key").eqNullSafe(F.col(key)), "left")
    return joined.select(F.col("__key").alias(key), F.coalesce(column, F.array().cast("array<bigint>")).alias(column))


def _rank(bounds: list[int], value: Column) -> Column:
    """How many of the ascending bounds are at most the value, looked up in two steps."""
    step = max(1, math.isqrt(len(bounds)))
    rows = F.array(*[F.lit(b) for b in bounds[step - 1 :: step]]) if len(bounds) >= step else F.array().cast("array<bigint>")
    coarse = F.size(F.filter(rows, lambda b: b <= value)) * step
    fine = F.slice(F.array(*[F.lit(b) for b in bounds]), coarse + 1, step) if bounds else F.array().cast("array<bigint>")
    return coarse + F.size(F.filter(fine, lambda b: b <= value))


def edited_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """Each document's sketch, that of the document edited with its successor's beginning, and how alike they are.

    The last half of the text is replaced by as much of the next document (by
    ascending id; after the last comes the first). Texts shuffle once, into
    ranges of ids; a range's first document is also sent to the range before
    it. Null ids come first; equal ids are in the order of their texts' hashes.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), key.alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    bounds = sorted(set(cuts or []))
    ranked = rows.select("*", _rank(bounds, F.col("k")).alias("range"))
    firsts = sorted(map(tuple, ranked.select("range", "k").groupBy("range").agg(F.min("k")).collect()))  # one row a range
    first, before = [None] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for i, (r, k) in enumerate(firsts):
        first[r], before[r] = k, firsts[i - 1][0]
    array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    own = F.struct(F.col("range"), F.lit(0).alias("guest"))
    guest = F.struct(F.get(array(before), F.col("range")).cast("int").alias("range"), F.lit(1).alias("guest"))
    is_first = F.get(array(first), F.col("range")) == F.col("k")
    dealt = ranked.select(
        "doc_id", "k", "text", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))).alias("at")
    ).select("doc_id", "k", "text", "at.range", "at.guest", F.xxhash64("text").alias("h"))
    order = Window.partitionBy("range").orderBy("guest", "k", "h")
    half = F.floor(F.length("text") / 2).cast("int")
    n = F.length("text")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    pairs = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("edited", F.coalesce(edited, F.lit("")))
    pairs = pairs.select("doc_id", "k", "h", "range", "guest", "text", "edited", n.cast("long").alias("n_chars"))
    pairs = pairs.withColumn("edited_sha256", F.sha2("edited", 256))
    made = with_sketches(pairs, {"sketch": "text", "edited_sketch": "edited"}, size, shingle).drop("text", "edited")
    made = made.withColumn("next_sketch", F.lead("sketch").over(order)).filter("guest = 0")
    return made.select(
        "doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), size).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), size).alias("near_next"),
        containment(F.col("sketch"), F.col("next_sketch"), size).alias("inside_next"),
        distinct_count(F.col("sketch"), size).alias("n_shingles"),
    )
