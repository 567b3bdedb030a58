"""Hard negatives, license notices and tokenizer alignment against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from millrace.llm import cross_tokens, hard_negatives, licenses, queries
from millrace.llm.tokens import vocabulary
from millrace.sources.tables import table

# ---- hard negatives


def mined(rows, window=(50, 95), n_positives=5, n_negatives=3):
    """Every anchor against every row, in plain loops. ``rows``: (id, vector, label)."""
    part = [(i, v, label) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    part = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in part]
    out = []
    for n, (anchor, v, label) in enumerate(part):
        if anchor is None or anchor % 50:
            continue
        others = [(-sum(a * b for a, b in zip(v, w)), j if j is not None else 1 << 70, lb) for m, (j, w, lb) in enumerate(part) if m != n]
        others.sort()
        for s, j, _ in [x for x in others if x[2] == label][:n_positives]:
            fits = [x for x in others if x[2] != label and window[0] * -s <= 100 * -x[0] <= window[1] * -s][:n_negatives]
            out += [(anchor, None if j == 1 << 70 else j, r, None if k == 1 << 70 else k, -s, -t) for r, (t, k, _) in enumerate(fits, 1)]
    return out


def vectors(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    return [(i, (spread * (centres[i % 4] + rng.normal(size=dim)) / math.sqrt(dim)).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(n)]


ODD = [
    (None, [0.1] * 6, 1), (50, [0.2] * 6, 1), (50, [0.2] * 6, 1), (50, [-0.2] * 6, 2), (7, None, 1), (8, [0.1, None] + [0.0] * 4, 1),
    (9, [float("nan")] * 6, 0), (11, [float("inf")] * 6, 0), (100, [0.0] * 6, 0), (12, [0.0] * 6, 0), (13, [0.3] * 3, 0), (150, [], 0), (14, [0.1] * 6, None),
    *[(1000 + i, [0.15] * 6, 0) for i in range(12)], *[(2000 + i, [0.2] * 6, 1) for i in range(12)],
]
SCHEMA = "vec_id long, embedding array<float>, label int, row string, vector int, score double"


@pytest.mark.parametrize("rows, cells", [(vectors(400, 24, 1), 1 << 18), (vectors(300, 5, 2), 10), (ODD, 1 << 18), (vectors(120, 16, 3, 0.01), 40), (vectors(260, 40, 4) + ODD, 80)])
def test_hard_negatives(spark, rows, cells):
    df = spark.createDataFrame([(*r, "x", 7, 0.5) for r in rows], SCHEMA).repartition(5)
    whole = hard_negatives.whole_vectors(df)
    got = [tuple(r) for r in hard_negatives.mine(whole, F.col("vec_id") % 50 == 0, block_cells=cells).collect()]
    assert sorted(map(str, got)) == sorted(map(str, mined(rows)))


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(hard_negatives.whole_vectors(df), F.col("vec_id") % 50 == 0).count() == 0
    df = spark.createDataFrame([(1, [0.5], 1, "x", 1, 0.0)], SCHEMA)
    assert hard_negatives.mine(hard_negatives.whole_vectors(df), F.col("vec_id") % 50 == 0).count() == 0
    big = spark.createDataFrame([(50, [3e8], 1, "x", 1, 0.0)], SCHEMA)
    with pytest.raises(ValueError):
        hard_negatives.mine(hard_negatives.whole_vectors(big), F.col("vec_id") % 50 == 0)


def test_pairs_are_pruned_but_never_lost():
    rng = np.random.default_rng(5)
    anchors, rows = (np.floor(256 * rng.normal(size=(n, 32)) / 6) for n in (30, 200))
    norms = hard_negatives.norms_before(anchors)
    scores = anchors @ rows.T
    for share in (0.9, 0.5, 0.3, 0.0):
        least = share * norms[:, -1] * 256
        which, row = hard_negatives.close_pairs(anchors, norms, rows, least)
        assert set(zip(*np.nonzero(scores >= least[:, None]))) <= set(zip(which, row))
        assert len(which) < (0.2 if share >= 0.5 else 1) * scores.size


# ---- licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_in(text):
    return WORD.findall((text or "").translate(LOWER))


def base_places(text):
    words, out = words_in(text), []
    for phrase, label in licenses.BASE.items():
        own = phrase.split()
        out += [(i, label) for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
    return out


TEXTS = [
    None, "", " .. ", "MIT License", "mit licence x", "the MIT-Licens; apache\n licence", "it license permit license", "general public license general public license",
    "Mit  LICENSE mit license mit licence", "é mit licensé ü mit license", "mit", "license mit", "gnu leser general public license v3", "Licensed under CC-BY-NC 4.0",
    "a general publik licence b", "redistribution and use in sourc and binary forms", "apachelicense", "apache li cense", "mit\x7flicense", "apache license.\n\nMIT License",
    "lice" * 3000, "mit license " * 3000, "mit licence " * 3000, "mit mit license license", "日本 mit license 語", "x" * 20 + "mit license", "general mit license public license",
]


def test_licenses(spark):
    rows = [(i, t, "s", "labels", 3) for i, t in enumerate(TEXTS)] + [(None, "mit license", None, "x", 1), (3, "MIT License", "s", "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, labels string, n_words int").repartition(3)
    got = licenses.scan_licenses(df).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        t, base = text[r.doc_id], base_places(text[r.doc_id])
        assert (r.n_words, r.n_base) == (len(words_in(t)), len(base))
        assert (r.first_base, r.last_base) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert r.base_labels == sorted({label for _, label in base}) and set(r.base_labels) <= set(r.labels)
        assert r.score == pytest.approx(max((1 - s.edits / len(s.notice) for s in r.spans), default=0.0)) and 0 <= r.score <= 1
        for s in r.spans:
            assert t[s.start : s.end] == s.found and words_in(s.found) == words_in(t)[s.first_word : s.last_word + 1]
            assert regex.fullmatch(f"(?:{s.notice}){{e<={s.edits}}}", " ".join(words_in(s.found)))
    labels = {r.doc_id: r.labels for r in got if r.doc_id is not None}
    assert labels[4] == ["mit"] and labels[5] == ["apache", "mit"] and labels[6] == [] and labels[12] == ["gpl", "lgpl"]
    assert labels[13] == ["cc"] and labels[14] == ["gpl"] and labels[15] == ["bsd"] and labels[22] == ["mit"]
    assert len(next(r for r in got if r.doc_id == 22).spans) == 3000
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_no_place_within_the_edits_is_missed():
    """Notices with random edits in random text: the pattern tried everywhere finds nothing that the seeds did not."""
    random.seed(4)
    of = licenses.scanner(licenses.NOTICES)
    for _ in range(300):
        n = random.randrange(len(licenses.NOTICES))
        notice = licenses.NOTICES[n]
        text = list(notice.text)
        for _ in range(random.randint(0, notice.edits)):
            at = random.randrange(len(text))
            text[at : at + 1] = random.choice([[], ["q"], [text[at], "é"], [text[at], text[at]]])
        text = " ".join(random.choices(["th", "nd", "public", "license"], k=3)) + " " + "".join(text) + " " + " ".join(random.choices(["on", "mit", "er"], k=3))
        slices = list(licenses.words_of(pa.array([text]), licenses.ALNUM, True))
        found = {m.notice for w in slices for _, matches in of.scan(w) for m in matches}
        plain = " ".join(words_in(text))
        expected = of.patterns[n].search(plain)
        if expected and licenses._in_order(of.short_words[n], expected.group().split(" ")):
            assert found, (text, notice.text)  # this notice, or a closer one around it


def test_seeds_are_the_notice():
    for notice in licenses.NOTICES:
        seeds = notice.seeds()
        assert "".join(s for _, s in seeds) == notice.text and len(seeds) == notice.edits + 1 and min(len(s) for _, s in seeds) >= 4


# ---- alignment of tokenizers

PATHS = vocabulary(queries.CROSS_A), vocabulary(queries.CROSS_B)
MIXED = [
    "", None, " ", "  ", "\n\n a  b  c", "café ÉtÉ, ab́ cd", "it's  we're I'LL", "a" * 4000, "x  y 　z", "\x85 q", "<|endoftext|> a<|startoftext|> <s></s><unk>", "a▁b",
    "▁", " ▁ x", "<0x0A> \t", "İstanbul ΣΣ ﬁ", "tab\tx \t y\r\n z  ", "日本語のテキスト。これ", "\U0001F600 \U0001F600", "\0 a\0b", "word " * 300, "the the the", "the the the", "word ",
]


def aligned(text):
    """Ids, groups and links of a whole text, by the libraries and plain lists."""
    of = cross_tokens.aligner(*PATHS)
    if not text:
        return [], [], [], []
    a, b = of.a.encoder.tokenizer.encode(" " + text, add_special_tokens=False).ids, of.b.model.encode(text)
    a_bytes, b_bytes = [of.a.bytes[i].as_py() for i in a], [of.b.bytes[i].as_py() for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return [], [], [], []
    ends_a, ends_b = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
        links.append((a[k - 1], b[m - 1]))
        i, j = k, m
    return a, b, groups, links


def expected_rows(rows):
    made = {t: aligned(t) for t in {t for _, t in rows}}
    count = collections.Counter(link for _, t in rows for link in made[t][3])
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for d, t in rows:
        a, b, groups, links = made[t]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        n_best = sum(count[x] == best[x[1]] for x in links)
        out.append((d, len(a), len(b), len(groups), len(links), n_best, sum(count[x] for x in links), digest))
    return out


@pytest.mark.parametrize("part_bytes", [4 << 20, 300])
def test_cross_tokens(spark, part_bytes):
    rows = [(i, t) for i, t in enumerate(MIXED)] + [(None, "the the"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, part int, links string").repartition(3)
    got = cross_tokens.align_documents(df, *PATHS, part_bytes=part_bytes)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected_rows(rows)))
    assert cross_tokens.align_documents(df.limit(0), *PATHS).count() == 0


def test_cross_tokens_of_documents(spark, folder):
    docs = table(spark, folder, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op13_cross_tokens(spark, folder).collect())) == sorted(expected_rows(rows))


def test_groups_are_slices_of_both_sides(spark):
    df = spark.createDataFrame(list(enumerate(MIXED)), "doc_id long, text string")
    for r in cross_tokens.aligned_groups(df, *PATHS).collect():
        a, b, groups, _ = aligned(MIXED[r.doc_id])
        assert (r.a_ids, r.b_ids) == (a, b)
        cuts = zip([0, *r.a_ends], r.a_ends, [0, *r.b_ends], r.b_ends)
        assert [",".join(map(str, a[i:j])) + "|" + ",".join(map(str, b[k:m])) for i, j, k, m in cuts] == groups


def test_long_texts_are_aligned_in_blocks():
    of, texts = cross_tokens.aligner(*PATHS), ["some words of a text, " * 200, "", "z" * 900, "end"]
    whole, cut = (cross_tokens.Texts(of, pa.array(texts), n) for n in (8 << 20, 100))
    assert whole.digests == cut.digests and (whole.links == cut.links).all() and (whole.n_a == cut.n_a).all()


def test_gallop():
    rng = np.random.default_rng(6)
    for _ in range(50):
        a, b = (np.append(np.sort(rng.choice(999, n, replace=False)) + 1, 1000) for n in rng.integers(1, 300, 2))
        i, j = cross_tokens.common_ends(a, np.array([len(a)]), b, np.array([len(b)]))
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
