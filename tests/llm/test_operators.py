"""The operators against brute force, over the smallest tables and rows made to be awkward."""

import collections
import hashlib
import html
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import chat, components, decontaminate, fingerprint, html_crf, neardup, oracles, orc_ids, packing, quality, queries, substring, tokens, warc, words
from millrace.llm.tokens import Encoder, encoder, vocabulary
from millrace.sources.tables import TABLES, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, score string, items int"
FORMATTED = "conv_id long, turn long, role string, text string, formatted int"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


ROWS = [
    (1, lines(60)), (2, lines(60)), (3, lines(60) + " more"), (4, None), (5, ""), (6, "one"), (7, "One two  three"),
    (8, lines(30, 500) + " " + lines(20)), (9, "a " * 50), (10, lines(25_000, 1000)), (11, "é ß Ü  x\ty"), (12, lines(60)), (12, lines(60)),
    (None, lines(60)), (None, "lost"), (13, " \n "),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, None, "s", None, 7, "x", 1) for d, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracles.all_sql()))
def test_twins(spark, folder, con, name):
    df = queries.REGISTRY[name](spark, folder)
    names = sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(con.execute(f"select {', '.join(names)} from ({oracles.all_sql()[name]})").fetchall())


def test_decontaminate(spark, docs, empty):
    bench = spark.createDataFrame(
        [("b", lines(20)), ("a", "ONE"), ("c", None), ("d", ""), (None, lines(14, 500)), ("e", lines(40, 20_000)), ("a", "one two")],
        "item_id string, text string",
    )
    found = decontaminate.find_matches(docs, bench, carry=["doc_id"]).collect()
    got = sorted((x.doc_id or 0, x.n_words, x.n_hit, tuple(x["items"])) for x in found)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for d, t in ROWS:
        w, hit, items = word.findall((t or "").translate(LOWER)), set(), set()
        for item, text in bench.collect():
            b = word.findall((text or "").translate(LOWER))
            k = min(13, len(b))
            wins = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    items |= {item} - {None}
        want.append((d or 0, len(w), len(hit), tuple(sorted(items))))
    assert got == sorted(want)
    longest = {x.doc_id: max((m.n_words for m in x.matches), default=0) for x in found}
    assert longest[10] == 40 and longest[1] == 20
    blocks = decontaminate.find_matches(docs, bench, carry=["doc_id"], block_chars=100).collect()
    assert sorted((x.doc_id or 0, x.n_words, x.n_hit, tuple(x["items"])) for x in blocks) == got
    assert decontaminate.find_matches(empty, bench).count() == 0
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and {(x.n_words, x["items"], x.score) for x in clean.collect()} == {(7, 1, "x")}
    assert decontaminate.remove_contaminated(docs, bench.limit(0)).count() == len(ROWS)


def test_repetitive_texts_cost_no_pairs():
    bench = decontaminate.Suffixes(["r", "s", "t"], ["w " * 4000, "w " * 3000 + lines(30), lines(30)], 13)
    column = pa.array(["w " * 20_000 + lines(30), "w w", None, "x " + lines(30) + " y"])
    start = time.process_time()
    parts = list(decontaminate.find(column, bench))
    assert time.process_time() - start < 5
    hit = np.concatenate([p.hit for p in parts])
    assert hit.sum() == 20_030 + 30
    rows = [(p.first + t, bench.ids[i], a, b, n) for p in parts for t, i, a, b, n in zip(*(x.tolist() for x in p.matches))]
    assert (0, "r", 0, 0, 4000) in rows and (0, "t", 0, 20_000, 30) in rows and (3, "t", 0, 1, 30) in rows
    assert {p.first + t: {bench.ids[i] for i in x} for p in parts for t, x in p.items.items()} == {0: {"r", "s", "t"}, 3: {"s", "t"}}


def test_copies_of_an_item_are_dealt_to_all_blocks(spark, docs):
    bench = spark.createDataFrame([(f"c{i}", lines(20)) for i in range(60)], "item_id string, text string")
    rows = bench.selectExpr("item_id i", "text t")
    sizes = [len(decontaminate._block(rows, 5, k)[0]) for k in range(5)]
    assert sum(sizes) == 60 and max(sizes) < 30
    one, more = (decontaminate.find_matches(docs, bench, carry=["doc_id"], block_chars=n) for n in (10**6, 1000))
    key = lambda x: str(x)
    assert sorted(map(key, (tuple(r)[:4] for r in one.collect()))) == sorted(map(key, (tuple(r)[:4] for r in more.collect())))


def test_fingerprints(docs, empty):
    made = fingerprint.edited_fingerprints(docs).collect()
    assert len(made) == len(ROWS) and fingerprint.edited_fingerprints(empty).count() == 0
    by = collections.defaultdict(list)
    for x in made:
        by[x.doc_id].append(x)
    assert by[1][0].sketch == by[2][0].sketch and by[1][0].near_next == 1.0
    assert by[4][0].n_chars == 0 and by[4][0].sketch == [] and by[4][0].near_next == 1.0
    assert by[2][0].near_next == pytest.approx(56 / 57) and by[2][0].n_shingles == 56 and by[2][0].inside_next == 1.0
    text = lines(60)
    want = text[: len(text) - len(text) // 2] + (text + " more")[: len(text) // 2]
    assert by[2][0].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert abs(by[10][0].n_shingles - 24_996) < 8_000


def test_sketches_merge(spark):
    parts = spark.createDataFrame([(1, lines(300)), (1, lines(300, 200)), (2, None)], "g int, text string")
    merged = {x.g: x.s for x in fingerprint.merge(fingerprint.with_sketches(parts, {"s": "text"}, 16), "g", "s", 16).collect()}
    apart = fingerprint.with_sketches(parts, {"s": "text"}, 16).collect()
    assert merged[1] == sorted({h for x in apart if x.g == 1 for h in x.s})[:16] and merged[2] == []


def test_quality(spark, folder, docs, empty):
    labels = table(spark, folder.replace("sf0.001", "sf0.01"), "labels")
    rows = table(spark, folder.replace("sf0.001", "sf0.01"), "documents").join(labels, "doc_id")
    model = quality.train(rows.filter(~quality.held_out()))
    seen = quality.score(rows.filter(quality.held_out()), model, carry=["doc_id", "quality"]).collect()
    assert np.mean([(x.score >= 0.5) == x.quality for x in seen]) > 0.95
    scored = quality.score(docs, model).collect()
    assert len(scored) == len(ROWS) and all(0 <= x.score <= 1 for x in scored)
    assert quality.score(empty, quality.train(rows.limit(0))).count() == 0


def test_the_sample_is_bounded_under_ties(spark):
    rows = spark.createDataFrame([(i % 3, f"text {i}", i % 2) for i in range(300)], "h long, t string, y int").repartition(4)
    for n in (1, 100, 150, 300, 400):
        got = quality.least(rows, n).collect()
        assert len(got) == min(n, 300) and sorted(x.h for x in got) == sorted(i % 3 for i in range(300))[:n]
        assert set(got) == set(quality.least(rows.repartition(2), n).collect())
    assert quality.least(rows.limit(0), 5).count() == 0


def test_near_duplicates(docs, empty):
    got = {(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(docs).collect()}
    assert {(1, 57, 1, True), (2, 57, 1, False), (3, 58, 1, False), (12, 57, 1, False), (4, 0, 4, True), (6, 1, 6, True), (9, 1, 9, True)} <= got
    assert (None, 57, None, True) in got
    assert neardup.near_duplicates(empty).count() == 0
    assert sorted(x.doc_id or 0 for x in neardup.keep_one(docs).collect()) == [0, 0, 1, 4, 5, 6, 7, 8, 9, 10, 11, 13]


def test_an_id_with_two_texts_has_the_links_of_both(spark):
    a, b = lines(100), lines(100, 5000)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, lines(50, 9000)), (4, a.replace("w50 ", "")), (5, None), (5, "")]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        got = [(x.doc_id, x.component_id) for x in neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()]
        assert sorted(got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (4, 1), (5, 5), (5, 5)]


def test_near_duplicates_of_a_chain(spark):
    """Copies that drift: only neighbours are linked, all are one group."""
    rows = [(i, lines(200, 6 * i)) for i in range(60)] + [(100 + i, lines(40, 9000 + 35 * i)) for i in range(30)]
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(60)) and all(got[100 + i] == 100 + i for i in range(30))


def test_signatures_estimate_resemblance():
    random = np.random.default_rng(1)
    errors = []
    for n in (20, 300, 2000):
        a = random.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.concatenate([random.integers(0, 1 << 62, n // 4).astype(np.uint64), a[n // 4 :]])
        s = neardup.signatures(np.repeat([0, 1], n), np.concatenate([a, b]), 2)
        errors.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert max(map(abs, errors)) < 0.15


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (None, 3), (150, 149)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long").repartition(4), "a", "b").collect())
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 151)}}


def brute_removed(rows, width=13):
    words = [(d, SPACED.findall(t or "")) for d, t in rows]
    least = {}
    key = lambda d: float("inf") if d is None else d
    for d, w in words:
        for i in range(len(w) - width + 1):
            x = tuple(w[i : i + width])
            least[x] = min(least.get(x, float("inf")), key(d))
    out = []
    for d, w in words:
        gone = {j for i in range(len(w) - width + 1) if least[tuple(w[i : i + width])] < key(d) for j in range(i, i + width)}
        out.append((d or 0, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def test_repeated_passages(docs, empty):
    kept = substring.remove_repeats(docs, carry=["doc_id"], part_bytes=1 << 12, shard_bytes=1 << 12)
    assert sorted((x.doc_id or 0, x.n_words, x.n_removed, x.text) for x in kept.collect()) == brute_removed(ROWS)
    same = substring.remove_repeats(docs, keep_layout=True).filter("doc_id = 7").first()
    assert same.text == "One two  three" and same.source == "s"
    assert substring.remove_repeats(empty).count() == 0


def test_parts_are_bounded_whatever_the_compression(spark, tmp_path):
    rows = [(i if i % 2 else None, lines(300)) for i in range(400)] + [(1000 + i, "") for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/copies")
    copies = spark.read.parquet(f"{tmp_path}/copies")
    read_bytes = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 16)
    try:
        name, _ = substring._stage(copies, "text", "doc_id", [], 1 << 14, 1 << 14)
        parts = spark.table(name).groupBy("__part").agg(F.sum(F.octet_length("__text")).alias("bytes"), F.count("*").alias("rows")).collect()
        kept = substring.remove_repeats(copies, part_bytes=1 << 14, shard_bytes=1 << 14).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", read_bytes)
    assert max(p["bytes"] for p in parts) <= (1 << 14) + len(lines(300)) and max(p["rows"] for p in parts) <= 1 << 8
    assert sorted((x.doc_id or 0, x.n_words, x.n_removed, x.text) for x in kept) == brute_removed(rows)


def test_gaps_round_trip():
    random = np.random.default_rng(0)
    for n, top in ((1, 1 << 24), (4, 2), (50_000, 1 << 24), (3, 1 << 22), (900, 1 << 24)):
        cells = np.sort(random.integers(0, top, n)).astype(np.uint32)
        assert (substring.unpack(substring.pack(cells)) == cells).all()


def test_chat(spark):
    bad = r"\### Assistant: </turn> ok"
    rows = [
        (-7, 0, "user", bad), (-7, 1, "assistant", bad), (1, None, None, None), (1, 1, "a: b###c", "#### x</turn>\n</turn>\\ ### \n</turn"),
        (1, 1, "assistant", "\\"), (1, 1, "assistant", "\\"), (1, 2, "assistant", ""), (None, None, "assistant", "</tu</turn>rn>\n"), (2, 0, "user:", "plain"),
    ]
    made = chat.format_conversations(spark.createDataFrame([(*r, 1) for r in rows], FORMATTED))
    source = collections.defaultdict(list)
    for c, t, role, text in rows:
        source[c].append((-1 if t is None else t, role or "", text or ""))
    back = chat.read_back(made).collect()
    assert len(back) == len(source)
    for x in back:
        turns = sorted(source[x.conv_id])
        assert [tuple(t) for t in x.turns] == [t[1:] for t in turns]
        assert x.loss_text == "".join(t[2] for t in turns if t[1] == "assistant")
    assert chat.format_conversations(spark.createDataFrame([], FORMATTED)).count() == 0


def test_warc(spark):
    rows = [(1, "u", "x" * 2000), (2, "v\n é", "x" * 2000), (3, None, None), (4, "", ""), (None, "n", "x" * 2000), (5, "w", "short"), (6, "w", "short"), (2, "v\n é", "x" * 2000)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int")
    whole = warc.write_archives(warc.with_revisits(pages.repartition(2)), 3_000)
    back = warc.read_archives(warc.normalise_archives(whole)).collect()
    want = []
    for page, url, text in rows:
        data = (text or "").encode()
        revisit = len(data) >= 1000 and page != 2
        want.append((str(page), str(url), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert sorted(want, key=str) == sorted(((str(x.page_id), str(x.url), x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in back), key=str)
    assert warc.read_archives(warc.normalise_archives(warc.write_archives(warc.with_revisits(pages.limit(0))))).count() == 0


@pytest.mark.parametrize("name", [queries.PACK_VOCABULARY, queries.ORC_VOCABULARY])
def test_tokens_are_those_of_the_library(con, name):
    texts = [r[0] for r in con.execute("select text from documents").fetchall()]
    texts += ["a  b\n\n c\t\t x\x1c!!  'll don't  é", "  ", "", " a", "a ", "\n", "a\nb\n", "\na \n b", "x\0 y\0\nz", "a\xa0b \xa0c", " \n", "0 \n1", "it's\n's 's", "<|endoftext|> x"]
    texts += ["U.S.A. x,y;Z!? a.\u0301 b's.c", "Éa ÀB.\nNo.1 caf\xe9\xa0b", "İstanbul ΣΣ. ﬁ µ ª", "a\u0301 ,.b", "y" * 9000, "a.b" * 500]
    own = Encoder(vocabulary(name))
    own.memory.limit = 20_000  # pieces are given up again and again
    plain = own.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [c for i in range(0, len(texts), 40) for c in ids_of(own, texts[i : i + 40])] == [e.ids for e in plain]
    assert ids_of(own, [None, ""]) == [[], []] and ids_of(own, []) == []


def ids_of(own, texts):
    ids, bounds = own.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_a_text_is_worked_off_in_blocks():
    text = "word, and\n\nmore " * 400
    data, bounds = words.text_buffers(pa.array([text, "x" * 3000, ""]))
    starts = tokens.piece_starts(data, bounds, marks=True)
    blocks = list(tokens.pieces_of(data, starts, 500))
    assert "".join(b.distinct[i] for b in blocks for i in b.which.to_pylist()) == text + "x" * 3000
    assert max(sum(len(b.distinct[i]) for i in b.which.to_pylist()) for b in blocks[:-1]) <= 500 and len(blocks) > 12


def test_what_is_remembered_is_bounded():
    memory = tokens.Memory(lambda pieces: [p.encode() for p in pieces], limit=4000)
    for i in range(300):
        assert memory.get([f"p{i}", "often", "l" * 100, f"p{i}"]) == [f"p{i}".encode(), b"often", b"l" * 100, f"p{i}".encode()]
    kept = {**memory.recent, **memory.older}
    assert "often" in kept and "l" * 100 not in kept and len(kept) * tokens.ENTRY_BYTES < 2 * 4000


def test_packing(docs, empty):
    path = vocabulary(queries.PACK_VOCABULARY)
    pieces = packing.pack(docs, path, 2, length=512).collect()
    ids = [c + [2] for c in ids_of(encoder(path), [t for _, t in ROWS])]
    assert sum(p.length for p in pieces) == sum(map(len, ids))
    full = {d: i for (d, _), i in zip(ROWS, ids) if d}
    sequences = collections.defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and len(p.ids) == p.length
        assert p.doc_id is None or full[p.doc_id][p.start : p.start + p.length] == p.ids
        sequences[p.sequence_id].append((p.offset, p.length))
    for s, parts in sequences.items():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and (ends[-1] == 512 or s == max(sequences))
    assert packing.pack(empty, path, 2).count() == 0


def test_hilbert_neighbours():
    points = np.stack(np.meshgrid(*[np.arange(4)] * 4), -1).reshape(-1, 4)
    order = points[np.argsort(packing.hilbert_key(points, 2))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_orc_ids(spark, docs, empty):
    path = vocabulary(queries.ORC_VOCABULARY)
    folder = orc_ids.write_ids(docs, path, 0)
    rows = sorted(orc_ids.read_digests(spark, folder).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in rows] == sorted((d for d, _ in ROWS), key=lambda d: (d is not None, d))
    assert [x.start for x in rows] == [sum(y.n_tokens for y in rows[:i]) for i in range(len(rows))]
    text = dict(ROWS)
    for x in rows:
        if x.doc_id:
            data = ids_of(encoder(path), [text[x.doc_id]])[0]
            assert x.ids_crc32 == zlib.crc32(np.append(data, 0).astype("<u4").tobytes())
    assert orc_ids.read_ids(spark, folder, [7, 12]).count() == 3
    assert orc_ids.read_digests(spark, orc_ids.write_ids(empty, path, 0)).count() == 0


def test_orc_ids_of_equal_ids_stand_in_a_fixed_order(spark):
    path, rows = vocabulary(queries.ORC_VOCABULARY), [(i % 2, f"text {i % 5} of an id") for i in range(60)]
    runs = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(5)
        found = orc_ids.read_digests(spark, orc_ids.write_ids(df, path, 0))
        runs.append([tuple(x) for x in found.orderBy("start").collect()])
    assert runs[0] == runs[1]


def test_main_text(spark, folder):
    pages = table(spark, folder, "pages")
    field = html_crf.train(pages)
    for x in html_crf.main_text(pages, field).join(pages.select("page_id", "html"), "page_id").collect():
        inside = x.html[x.html.index("<article>") + 9 : x.html.index("</article>")]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert x.text == "\n".join(p for p in parts if p)
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "u", "<p"), (3, "u", "<nav><a href=x>Home</a></nav>")], "page_id long, url string, html string")
    assert [x.text for x in html_crf.main_text(odd, field).filter("page_id is not null").orderBy("page_id").collect()] == ["", "", ""]
    page, name = html_crf.PRIMER[3]
    assert html_crf.extract(page, field).split("\n")[:3] == ["A story told at length", "It begins here, with a sentence.", "It goes on."]


def test_main_text_after_elements_without_an_end(spark, folder):
    field = html_crf.train(table(spark, folder, "pages"))
    story = "<article class=story><h1>A story told at length</h1><p>It begins here, with a sentence.</p><p>It goes on.</p></article>"
    want = "A story told at length\nIt begins here, with a sentence.\nIt goes on."
    starts = ["<svg class=\"i\"/>", "<svg class=i />", "<svg title='a > b'/>", "<svg-icon name=x></svg-icon>"]
    starts += [f"<{k} class=x>" for k in ("svg", "select", "noscript", "iframe", "template")] + ["<svg><style/><path d=z /></svg>", "<svg><style>a{}</svg>"]
    later = ["", "<svg><svg/>Unseen<g/></svg>", "<template>Unseen<template>it</template>too</template><select><option>Unseen</select>", "<iframe>Unseen<!-- </iframe><noscript>Unseen</noscript>"]
    for start in starts:
        for end in later:
            page = f"<nav>{start}Home</nav>{story}<div class=content>{end}</div>"
            assert [t for _, t, _ in html_crf.blocks_of(page)] == ["Home", *want.split("\n")], page
            assert html_crf.extract(page, field) == want, page
    for unended in ("script", "style", "textarea"):
        assert [t for _, t, _ in html_crf.blocks_of(f"{story}<{unended}>a{story}")] == want.split("\n")
    assert [t for _, t, _ in html_crf.blocks_of("<p>A <svg><path/></svg>picture<iframe src=http://a/>Unseen</iframe> in it")] == ["A picture in it"]


@pytest.mark.parametrize("piece, end, blocks", [("<a ", "", 1), ('<a "', "", 1), ('<a "', ">", 1), ("<div>a", "", 60_000), ("<div>a</p>", "", 60_000), ("<svg><script>", "", 0), ("<iframe>a", "", 60_000), ("<a ", '" >', 1), ("<!-", "", 1)])
def test_broken_pages_are_read_once(piece, end, blocks):
    page = piece * (60_001 if piece.endswith('"') else 60_000) + end
    start = time.process_time()
    found = html_crf.blocks_of(page)
    assert len(found) == blocks and time.process_time() - start < 5


def test_main_text_of_odd_tables(spark, folder):
    field = html_crf.train(table(spark, folder, "pages"))
    page = html_crf.PRIMER[3][0]
    rows = [(1, "u", page, "x"), (1, "u", page, "y"), (None, None, "<p>" * 3000, None)]
    got = html_crf.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), field).collect()
    assert len({r.text for r in got if r.page_id}) == 1 and len(got) == 3 and got[0].text.startswith("A story") and not any(r.text for r in got if not r.page_id)
    nothing = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_crf.main_text(nothing, field).count() == 0 and html_crf.main_text(nothing, html_crf.train(nothing)).count() == 0


def test_viterbi_finds_the_best_chain():
    field, random = html_crf.Field(), np.random.default_rng(2)
    for _ in range(20):
        field.step = random.normal(size=(2, 2))
        x = random.normal(size=6)
        def total(y):
            return sum(a * b for a, b in zip(x, y)) + sum(field.step[a, b] for a, b in zip(y, y[1:]))
        best = max(([n >> i & 1 for i in range(6)] for n in range(64)), key=total)
        assert total(field.decode(x.tolist())) == pytest.approx(total(best))


def test_pipeline(spark, folder):
    docs = start = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.settle(stage(spark, docs, folder), "test")
        assert docs.columns == start.columns and 0 < docs.count() <= before.count(), name
    pieces = corpus_pipeline.run(spark, folder)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    assert pieces.agg(F.sum("length")).first()[0] == sum(x.doc_tokens for x in pieces.select("doc_id", "doc_tokens").distinct().collect())
