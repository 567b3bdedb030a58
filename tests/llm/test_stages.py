"""The pipeline's stages and the sketches against brute force, whole tables."""

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import fingerprint, queries, quality
from millrace.llm.words import NOT_SPACE, words_of
from millrace.sources.tables import table

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, n_removed int, items int, __hit int"


def lines(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


ODD = [
    (1, lines(60)), (2, lines(60)), (3, lines(60) + " more"), (4, None), (5, ""), (6, "one"), (7, lines(30, 500) + " " + lines(20)), (8, "a " * 50),
    (9, "a " * 50), (10, lines(3000, 1000)), (11, lines(20, 5000) + "\n\n" + lines(30, 500)), (12, lines(60)), (12, lines(60)), (None, lines(60)), (None, None), (13, " \n "),
    (14, lines(20, 5000)), (14, lines(40, 7000)), (15, lines(40, 7000) + " end"),
]


def sets_of(text, width=5):
    words = SPACED.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def kept_of_groups(rows):
    """Rows that stay when one document of each group of near copies does, all pairs compared."""
    ids = sorted({d for d, _ in rows if d is not None})
    sets = {d: [s for i, t in rows if i == d and (s := sets_of(t))] for d in ids}
    group = {d: d for d in ids}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((root(a), root(b)))
                group[high] = low
    return [(d, t) for d, t in rows if d is None or root(d) == d]


def without_repeats(rows, width=13):
    """Texts without the words that a smaller document has in a window."""
    least = {}
    for d, t in rows:
        words = SPACED.findall(t or "")
        for i in range(len(words) - width + 1):
            key = tuple(words[i : i + width])
            least[key] = min(least.get(key, float("inf")), float("inf") if d is None else d)
    out = []
    for d, t in rows:
        words = SPACED.findall(t or "")
        gone = {j for i in range(len(words) - width + 1) if least[tuple(words[i : i + width])] < (float("inf") if d is None else d) for j in range(i, i + width)}
        out.append((d, " ".join(w for j, w in enumerate(words) if j not in gone) if gone else t or ""))
    return out


def clean_of(rows, items):
    out = []
    for d, t in rows:
        words, hit = ALNUM.findall((t or "").translate(LOWER)), set()
        for item in items:
            own = ALNUM.findall((item or "").translate(LOWER))
            k = min(13, len(own))
            windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
            for i in range(len(words) - k + 1):
                if windows and tuple(words[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
        if not hit or 20 * len(hit) < len(words):
            out.append((d, t))
    return out


def pairs_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.fixture(scope="module", params=["odd rows", "documents"])
def docs(request, spark, folder):
    if request.param == "documents":
        return table(spark, folder, "documents")
    rows = [(d, t, "en", "s", 5, "7.0", "kept", 3, 4, 1) for d, t in ODD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_near_duplicates_leave_one_of_each_group(spark, folder, docs):
    stage = corpus_pipeline.near_duplicate_stage(spark, docs, folder)
    assert stage.columns == docs.columns
    assert pairs_of(stage) == sorted(kept_of_groups([(r.doc_id, r.text) for r in docs.collect()]), key=str)


def test_substring_stage_takes_repeated_words(spark, folder, docs):
    stage = corpus_pipeline.substring_stage(spark, docs, folder)
    assert stage.columns == docs.columns and stage.dtypes == docs.dtypes
    want = without_repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert pairs_of(stage) == sorted(want, key=str)
    for r in stage.collect():
        assert r.n_chars == len(r.text) and (r.lang is None or "score" not in docs.columns or (r.score, r.n_words, r.n_removed) == ("7.0", "kept", 3))


def test_decontamination_stage_takes_what_holds_the_benchmark(spark, folder, docs):
    stage = corpus_pipeline.decontamination_stage(spark, docs, folder)
    items = [r.text for r in table(spark, folder, "benchmark").collect()]
    assert stage.columns == docs.columns
    assert pairs_of(stage) == sorted(clean_of([(r.doc_id, r.text) for r in docs.collect()], items), key=str)


def test_quality_stage_keeps_what_scores_half(spark, folder, docs):
    stage = corpus_pipeline.quality_stage(spark, docs, folder)
    assert stage.columns == docs.columns and stage.dtypes == docs.dtypes
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    model = quality.train(docs.select("doc_id", "text").join(labels, "doc_id").filter(~quality.held_out()))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    scores = [s for w in words_of(pa.array([t for _, t in rows], pa.string()), NOT_SPACE, True) for s in model.score(*quality.features(w))]
    assert pairs_of(stage) == sorted((r for r, s in zip(rows, scores) if s >= 0.5), key=str)


def test_stages_of_an_empty_table(spark, folder):
    nothing = table(spark, folder, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0, name


def test_the_identity_is_the_sum_over_pairs():
    """The linear-time score of the factorisation machine is that of all pairs, word by word."""
    rng = np.random.default_rng(8)
    texts = ["one two two three, four!", "", "A b\n\nC d 12 %", "x " * 30]
    words = next(words_of(pa.array(texts), NOT_SPACE, True))
    of, bucket, value, statistics = quality.features(words)
    model = quality.Model(0.3)
    model.weight = rng.normal(size=model.weight.shape).astype(np.float32)
    model.factor = rng.normal(size=model.factor.shape).astype(np.float32)
    model.mean, model.spread = statistics.mean(0), statistics.std(0) + 1e-3
    got, scaled = model.score(of, bucket, value, statistics), model.scale(statistics)
    for t in range(len(texts)):
        x = [(b, v) for o, b, v in zip(of, bucket, value) if o == t] + [(quality.BUCKETS + i, v) for i, v in enumerate(scaled[t])]
        total = model.bias + sum(float(model.weight[i]) * v for i, v in x)
        total += sum(float(model.factor[i] @ model.factor[j]) * v * w for n, (i, v) in enumerate(x) for j, w in x[n + 1 :])
        assert got[t] == pytest.approx(1 / (1 + np.exp(-np.clip(total, -30, 30))), rel=1e-4, abs=1e-6)


def test_learning_lowers_the_loss_and_follows_the_labels():
    texts = ["good words here, all of them fine"] * 40 + ["$$$ ### buy ### $$$"] * 40
    model = quality.fit([f"{t} {i}" for i, t in enumerate(texts)], [1] * 40 + [0] * 40)
    words = next(words_of(pa.array(texts), NOT_SPACE, True))
    scores = model.score(*quality.features(words))
    assert scores[:40].min() > 0.5 > scores[40:].max()  # texts that were not among those learned from


# ---- fingerprints


def sketch(text, size=fingerprint.SIZE, width=fingerprint.SHINGLE):
    """Bottom-k of shingle hashes by the xxhash library."""
    signed = lambda h: struct.pack("<q", h - (1 << 64) if h >= 1 << 63 else h)
    words = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in SPACED.findall(text.lower())]
    if not words:
        return []
    hashes = set()
    for i in range(max(1, len(words) - width + 1)):
        h = 42
        for w in words[i : i + width]:
            h = xxhash.xxh64(signed(w), seed=h).intdigest()
        hashes.add(h >> 16)
    return sorted(hashes)[:size]


def alike(a, b, size=fingerprint.SIZE):
    both = sorted({*a, *b})[:size]
    return len([h for h in both if h in a and h in b]) / len(both) if both else 1.0


def test_fingerprints_of_documents(spark, folder):
    docs = sorted((r.doc_id, r.text or "") for r in table(spark, folder, "documents").collect())
    got = {r.doc_id: r for r in queries.op2_fingerprints(spark, folder).collect()}
    digits = {r.doc_id: r.s for r in fingerprint.with_sketches(table(spark, folder, "documents"), {"s": "text"}).select("doc_id", "s").collect()}
    assert len(got) == len(docs)
    for (d, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, new, other = sketch(text), sketch(edited), sketch(following)
        r = got[d]
        assert digits[d] == own and (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(alike(own, new)) and r.near_next == pytest.approx(alike(own, other))
    by_text = {}
    for d, text in docs:
        assert by_text.setdefault(text, got[d].fingerprint) == got[d].fingerprint


def test_fingerprints_of_odd_rows(spark):
    rows = [(d, t, 1) for d, t in ODD if d not in (None, 12, 14)] + [(20, "é" * 9 + " ß  x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sketch int").repartition(3)
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(df).collect()}
    for (d, text, _), (_, following, _) in zip(rows, rows[1:] + rows[:1]):
        half = len(text or "") // 2
        edited = (text or "")[: len(text or "") - half] + (following or "")[:half]
        assert got[d].sketch == sketch(text or "") and got[d].edited_sketch == sketch(edited)
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
