import math
import re
from collections import Counter

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from millrace.functions import verbs
from millrace.operators import cells, conversation, models, summary
from millrace.plans import queries

LOG = [
    (1, 0, "system", "be kind"),
    (1, 1, "user", "hello  there"),
    (1, 2, "assistant", "hi"),
    (1, 3, "user", ""),
    (1, 4, "assistant", "still here"),
    (2, 0, "user", "x"),
]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(LOG, "conv_id long, turn long, role string, text string").repartition(3)


@pytest.mark.parametrize("chunk", [1024, 2, 1])
def test_history_points_into_the_transcript(log, chunk):
    rows = {(r.conv_id, r.turn): r for r in conversation.history(log, chunk).collect()}
    pieces = conversation.transcript(log, piece=2).orderBy("conv_id", "piece_no").collect()
    whole = {c: "".join(p.piece_text for p in pieces if p.conv_id == c) for c in (1, 2)}
    for conv, turn, _, _ in LOG:
        before = [(r, t) for c, n, r, t in LOG if c == conv and n < turn]
        r = rows[(conv, turn)]
        assert whole[conv][: r.chars_before] == "".join(f"{role}: {text}\n" for role, text in before)
        assert r.turns_before == len(before)
    assert rows[(1, 4)].question_no == 2 and rows[(1, 0)].question_no == 0
    assert max(p.n_turns for p in pieces) == 2


def test_tokens_and_cost(log):
    got = {r.conv_id: r for r in conversation.token_usage(log, prompt_rate=1.0, completion_rate=2.0).collect()}
    assert (got[1].prompt_tokens, got[1].completion_tokens, got[1].total_tokens) == (4, 3, 7)
    assert got[1].total_cost == pytest.approx(0.010)
    assert got[2].completion_tokens == 0


def test_words(log):
    got = [(r.turn, r.word_no, r.word) for r in conversation.word_rows(log.filter("conv_id = 1 and turn in (1, 3)")).collect()]
    assert sorted(got) == [(1, 0, "hello "), (1, 1, "there ")]


def brute_summary(docs, n_lines):
    docs = [(d, t or "") for d, t in docs]
    words = {d: [re.findall(r"[^\W_]+", line.lower()) for line in t.split("\n")] for d, t in docs}
    df = Counter(w for ls in words.values() for w in {w for line in ls for w in line})
    out = {}
    for d, t in docs:
        counts = Counter(w for line in words[d] for w in line)
        total = sum(counts.values())
        scored = []
        for i, line in enumerate(words[d]):
            if line:
                s = sum(counts[w] / total * math.log((1 + len(docs)) / (1 + df[w])) for w in line) / len(line)
                scored.append((-round(s, 9), i))
        best = sorted(i for _, i in sorted(scored)[:n_lines])
        out[d] = "\n".join("- " + t.split("\n")[i] for i in best)
    return out


DOCS = [
    (1, "The cat sat.\n\nA dog ran, a dog barked.\nThe end."),
    (2, "The cat\nthe cat\nthe bird flew far"),
    (3, "..."),
    (4, "One long line with the words"),
    (5, "the\nthe\nthe"),
    (6, None),
    (7, ""),
]


@pytest.mark.parametrize("share, most", [(1000, 500_000), (1, 500_000), (1, 2)])
def test_summary_matches_brute_force(spark, monkeypatch, share, most):
    """Also with every word, or only the commonest, looked up as a common one."""
    monkeypatch.setattr(summary, "HOT_SHARE", share)
    monkeypatch.setattr(summary, "MAX_HOT", most)
    df = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.summary for r in summary.extractive_summary(df, 2).collect()}
    assert got == brute_summary(DOCS, 2)


@pytest.mark.parametrize("most", [500_000, 2])
def test_summary_scores_documents_in_the_row(spark, monkeypatch, most):
    """Only ids of several rows have their words written and grouped; common and rare words together, a null id."""
    monkeypatch.setattr(summary, "MAX_HOT", most)
    written, settle = [], summary.settle
    monkeypatch.setattr(summary, "settle", lambda df, label: written.append(label) or settle(df, label))
    df = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.summary for r in summary.extractive_summary(df, 2).collect()} == brute_summary(DOCS, 2)
    assert "document-words" not in written
    more = spark.createDataFrame([*DOCS, (2, "a bird"), (None, "the lost cat")], "doc_id long, text string")
    got = [(r.doc_id, r.n_lines, r.summary) for r in summary.extractive_summary(more, 2).collect()]
    assert len(got) == 9 and (None, 0, "") in got and sorted(g[1] for g in got if g[0] == 2) == [2, 2]
    assert "document-words" in written


def brute_free_summary(text, max_words):
    """Weights and means worked out anew for every choice."""
    found = [x.strip() for line in (text or "").split("\n") for x in re.split(r"(?<=[.!?])(?=\s)", line)]
    found = [x for x in found if re.search(r"[^\W_]", x)]
    words = [re.findall(r"[^\W_]+", x.lower()) for x in found]
    total = sum(map(len, words))
    times = Counter(w for s in words for w in s)
    said, kept, passed = Counter(), [], set()
    while len(kept) + len(passed) < len(found):
        weight = {w: (n / total) ** (2 ** said[w]) for w, n in times.items()}
        mean = {i: sum(weight[w] for w in s) / len(s) for i, s in enumerate(words) if i not in kept and i not in passed}
        best = min(mean, key=lambda i: (-round(mean[i], 12), i))
        if kept and sum(len(words[i]) for i in kept) + len(words[best]) > max_words:
            passed.add(best)
            continue
        kept.append(best)
        said.update(set(words[best]))
        if sum(len(words[i]) for i in kept) >= max_words:
            break
    return len(kept), sum(len(words[i]) for i in kept), " ".join(found[i] for i in sorted(kept))


FREE = [*DOCS, (8, "Tea is good. Tea is good. Coffee is bad! Is it? No.\nTea, tea and tea"), (9, "one two three " * 90 + "end. Short one."), (None, "A b. C d."), (8, "again")]


@pytest.mark.parametrize("max_words", [1, 6, 180])
def test_free_summary_matches_brute_force(spark, max_words):
    df = spark.createDataFrame([(*r, 1) for r in FREE], "doc_id long, text string, summary int").repartition(3)
    got = [(r.doc_id, r.n_sentences, r.n_words, r.summary) for r in summary.free_summary(df, max_words).collect()]
    assert sorted(map(str, got)) == sorted(str((d, *brute_free_summary(t, max_words))) for d, t in FREE)
    assert summary.free_summary(df.limit(0)).count() == 0


def test_free_summary_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    short = [r for r in queries.free_summary(spark, folder).collect() if len(text[r.doc_id] or "") < 4000]
    assert len(short) > 100
    for r in short:
        assert (r.n_sentences, r.n_words, r.summary) == brute_free_summary(text[r.doc_id], summary.MAX_WORDS)


def test_templates_and_project(spark):
    assert {"id", "name", "description"} == set(models.templates(spark).columns)
    rows = [(i, "ab"[i % 2], float(i % 2) * 10 + (i % 7) * 0.01) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, c string, y double")
    project = models.create_project(df, "p", "linear", "lib.t", "y", ["c"], [], ["k"])
    assert project.results[0][1] < 1.0
    board = models.leaderboard(spark, project).collect()
    assert [r.champion for r in board] == [True] and board[0].template_id == "linear"
    assert "prediction" in project.champion.transform(df).columns
    with pytest.raises(ValueError):
        models.create_project(df, "p", "none", "lib.t", "y", ["c"], [], ["k"])


def test_learners_get_parts_of_bounded_rows(spark, monkeypatch):
    rows = [(i, "ab"[i % 2], float(i % 5)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, c string, y double")
    seen, learner = [], models._learner

    class Spy:
        def __init__(self, *args):
            self.inner = learner(*args)

        def fit(self, train):
            seen.append(train.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect())
            return self.inner.fit(train)

    monkeypatch.setattr(models, "_learner", Spy)
    small = models.create_project(df, "p", "linear", "lib.t", "y", ["c"], [], ["k"])
    monkeypatch.setattr(models, "ROWS_A_PART", 100)
    large = models.create_project(df, "p", "linear", "lib.t", "y", ["c"], [], ["k"])
    assert sum(seen[0]) == sum(seen[1]) and len(seen[0]) < 10
    assert len(seen[1]) == -(-sum(seen[1]) // 100) and max(seen[1]) < 200
    assert small.results[0][1] == pytest.approx(large.results[0][1])


def _project_of_cells(spark, n=6000, nulls=False):
    """Rows with a class of few levels and null, and a number of more values than a tree has bins; another number may have nulls, which trees alone take."""
    rows = [(i, "abc"[i % 3] if i % 11 else None, None if nulls and i % 13 == 0 else float(i % 7), float(i * 37 % 101), float(i % 3 * 5 + i * 37 % 101 // 10 + i * 7 % 10 / 7)) for i in range(n)]
    return spark.createDataFrame(rows, "k int, c string, u double, v double, y double")


def test_trees_of_large_tables_are_fitted_on_cells(spark, monkeypatch, tmp_path):
    df, fitted = _project_of_cells(spark), []
    learners = {kind: type(models._learner(kind, False)) for kind in ("forest", "boosting")}
    for kind, cls in learners.items():
        monkeypatch.setattr(cls, "_fit", lambda self, rows, kind=kind, fit=cls._fit: fitted.append((kind, rows.count())) or fit(self, rows))
    small = models.create_project(df, "p", "standard", "lib.t", "y", ["c"], ["u", "v"], ["k"])
    assert [kind for kind, _ in fitted] == ["forest", "boosting"] and min(n for _, n in fitted) > 4000
    fitted.clear()
    monkeypatch.setattr(models, "CELLS_FROM", 1000)
    large = models.create_project(df, "p", "standard", "lib.t", "y", ["c"], ["u", "v"], ["k"])
    assert len([k for k, _ in fitted if k == "forest"]) == 20 and max(n for _, n in fitted) <= 4 * 7 * 32  # bins of c, u and v
    by_rows, by_cells = dict(small.results), dict(large.results)
    assert by_cells["boosting"] == pytest.approx(by_rows["boosting"]) and by_cells["linear"] == pytest.approx(by_rows["linear"])
    assert by_cells["forest"] == pytest.approx(by_rows["forest"], rel=0.15)


def test_champion_of_cells_has_the_error_it_was_judged_by(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(models, "CELLS_FROM", 1000)
    df = _project_of_cells(spark, nulls=True)
    project = models.create_project(df, "p", "trees", "lib.t", "y", ["c"], ["u", "v"], ["k"])
    project.champion.write().overwrite().save(str(tmp_path / "m"))
    check, away = df.filter(~models.train_part(["k"])), F.col("y") - F.col("prediction")
    forest = {type(s).__name__ for s in project.champion.stages}
    assert forest & {"RandomForestRegressionModel", "GBTRegressionModel"}
    for champion in (project.champion, models.PipelineModel.load(str(tmp_path / "m"))):
        scored = champion.transform(check)
        assert scored.count() == check.count()
        assert scored.agg(F.sqrt(F.avg(away * away))).first()[0] == pytest.approx(project.results[0][1])


def test_forest_of_cells_can_be_stored(spark, tmp_path):
    df = _project_of_cells(spark, nulls=True).select("u", "v", F.col("y").alias("label"))
    bins = cells.Bins.of(df, ["u", "v"])
    learner = cells.CellLearner(bins, df, df, 4, seed=3)
    model = learner.fit(models._learner("forest", False).setNumTrees(4))
    assert model.getNumTrees == 4 and len(model.trees) == 4 and len({t.toDebugString for t in model.trees}) == 4
    whole = models.PipelineModel(stages=[*bins.stages(), model])
    whole.write().overwrite().save(str(tmp_path / "m"))
    away = F.col("label") - F.col("prediction")
    for made in (whole, models.PipelineModel.load(str(tmp_path / "m"))):
        assert made.transform(df).agg(F.sqrt(F.avg(away * away))).first()[0] == pytest.approx(learner.rmse(model))


def test_a_project_of_too_many_cells_keeps_its_rows(spark, monkeypatch):
    df = _project_of_cells(spark, 2000)
    monkeypatch.setattr(models, "CELLS_FROM", 100)
    monkeypatch.setattr(models, "MAX_CELLS", 50)
    project = models.create_project(df, "p", "standard", "lib.t", "y", ["c"], ["u", "v"], ["k"])
    assert {kind for kind, _ in project.results} == {"linear", "forest", "boosting"}
    assert type(project.champion.stages[-2]).__name__ == "VectorAssembler" and "prediction" in project.champion.transform(df).columns


def test_cell_sums_draw_every_row_for_every_tree(spark, monkeypatch):
    monkeypatch.setattr(cells, "CHUNK", 700)
    monkeypatch.setattr(cells, "SLICE", 2)
    rows = spark.range(20_000).select((F.col("id") % 5).alias("cell"), (F.col("id") % 7).cast("double").alias("label"))
    found = cells.cell_sums(rows, 9, 3, seed=1).collect()
    assert sorted((r.cell, r.n, r.s) for r in found) == [(c, 4000, sum(i % 7 for i in range(c, 20_000, 5))) for c in range(5)]
    for t in range(3):
        drawn = [(r[f"n{t}"], r[f"s{t}"]) for r in found]
        assert all(abs(n - 4000) < 5 * 4000**0.5 and abs(s / n - 3) < 0.2 for n, s in drawn) and sum(n for n, _ in drawn) != 20_000
    assert len({r.n0 for r in found} | {r.n1 for r in found} | {r.n2 for r in found}) > 5


def test_edges_as_trees_have_them():
    assert cells.edges_of_values([(3.0, 1), (1.0, 9), (2.0, 1)]) == [1.5, 2.5]
    assert cells.edges_of_values([(1.0, 5)]) == [] == cells.edges_of_values([])
    even = cells.edges_of_values([(float(v), 10) for v in range(64)])
    assert even == [1.5 + 2 * i for i in range(31)]
    # a common value keeps its own bin
    assert cells.edges_of_values([(float(v), 1000 if v == 9 else 1) for v in range(40)], 4)[:2] == [8.5, 9.5]


def test_bins_of_odd_values(spark):
    rows = [(float("nan"), 1.0, None), (None, 1.0, None), (float("inf"), 1.0, None), (-float("inf"), 1.0, None), (2.0, 1.0, None), (-0.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double").withColumn("label", F.lit(1.0))
    bins = cells.Bins.of(df, ["a", "b", "c"])
    assert bins.edges == [[1.0], [0.0], [0.0]] and bins.cells == 27
    numbered = bins.seen(bins.numbered(df)).collect()
    # infinite values are with their neighbours, nulls and NaN beyond all
    assert sorted(r.features[0] for r in numbered) == [0, 0, 1, 1, 2, 2]
    assert {(r.features[1], r.features[2]) for r in numbered} == {(1.0, 2.0)}


def test_bins_of_very_many_values(spark, monkeypatch):
    monkeypatch.setattr(cells, "MAX_VALUES", 100)
    df = spark.range(3200).select(F.col("id").cast("double").alias("a"), F.lit(0.0).alias("label"))
    sizes = cells.Bins.of(df, ["a"]).numbered(df).groupBy("cell").count().collect()
    assert len(sizes) == 32 and max(abs(r["count"] - 100) for r in sizes) < 10


def test_binary_project(spark):
    rows = [(i, "ab"[i % 2], float(i % 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, c string, y double")
    project = models.create_project(df, "p", "linear", "lib.t", "y", ["c"], [], ["k"], binary=True)
    assert project.metric == "areaUnderROC" and project.results[0][1] == pytest.approx(1.0)


def test_binary_project_in_a_session_that_has_observed(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i % 2)) for i in range(300)], "k int, c string, y double")
    project = models.create_project(df, "p", "linear", "lib.t", "y", ["c"], [], ["k"], binary=True)
    assert project.champion.transform(df).filter("prediction = y").count() == 300


def test_level_means_and_unseen_levels(spark, tmp_path):
    rows = [(i, f"c{i % 40}", None if i % 3 else "x", float(i % 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, c string, d string, label double")
    means = models.fit_level_means(df, ["c", "d"], prior=10.0)
    new = spark.createDataFrame([("c3", "x"), ("c39", None), ("other", "y"), (None, None)], "c string, d string")
    got = {(r.c, r.d): r for r in means.transform(new).collect()}
    overall = sum(r[3] for r in rows) / 400
    x = [r[3] for r in rows if r[2] == "x"]
    assert got[("c3", "x")].c__m == pytest.approx((30 + 10 * overall) / 20) and got[("c3", "x")].d__m == pytest.approx((sum(x) + 10 * overall) / (len(x) + 10))
    assert got[("other", "y")].c__m == got[(None, None)].c__m == got[("c39", None)].d__m == pytest.approx(overall)
    project = models.create_project(df, "p", "linear", "lib.t", "label", ["c"], [], ["k"])
    project.champion.write().overwrite().save(str(tmp_path / "m"))
    loaded = models.PipelineModel.load(str(tmp_path / "m"))
    assert loaded.transform(df).orderBy("k").select("prediction").collect() == project.champion.transform(df).orderBy("k").select("prediction").collect()


def test_fold_errors_by_hand(spark):
    rows = [(i, "ab"[i % 2] if i % 7 else None, f"only{i}", float(i % 5) if i % 11 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, c string, u string, y double").withColumn("fold", models.fold_of(["k"]))
    data = [r for r in df.collect() if r.y is not None]
    mean = lambda values: sum(values) / len(values)

    def rmse(column):
        errors = []
        for r in data:
            level = [x.y for x in data if x.fold != r.fold and column and x[column] is not None and x[column] == r[column]]
            errors.append((r.y - mean(level or [x.y for x in data if x.fold != r.fold])) ** 2)
        return math.sqrt(mean(errors))

    got = {r.model: r for r in models.fold_errors(df, "y", ["c", "u"], ["k"]).collect()}
    want = {"overall mean": rmse(None), "mean by c": rmse("c"), "mean by u": rmse("u")}
    assert {m: r.rmse for m, r in got.items()} == pytest.approx(want) and {r.n for r in got.values()} == {len(data)}
    assert sorted(r.rank for r in got.values()) == [1, 2, 3]
    assert models.fold_errors(df.limit(0), "y", ["c"], ["k"]).count() == 0


def test_text_classifier(spark):
    rows = [(i, "good fine nice" if i % 2 else "bad poor awful", float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, text string, label double")
    got = models.classify(df, models.fit_text_classifier(df), "i").collect()
    assert all(r.label == ("positive" if r.i % 2 else "negative") for r in got)


def test_text_classifier_by_hand(spark):
    rows = [(1, "a a b", 1), (2, "b c", 0), (3, None, 1), (4, "", 0), (5, "A zzz", None), (6, "unseen", None)]
    df = spark.createDataFrame(rows, "i int, text string, label int")
    weights = {r.word: r.weight for r in models.fit_text_classifier(df).collect()}
    assert weights[None] == pytest.approx(math.log(3 / 3)) and set(weights) == {None, "a", "b", "c"}
    assert weights["a"] == pytest.approx(math.log(3 / 6) - math.log(1 / 5))
    got = {r.i: r for r in models.classify(df, models.fit_text_classifier(df), "i").collect()}
    assert len(got) == 6 and got[5].label == "positive" and got[2].label == "negative"
    assert got[3].score == got[4].score == got[6].score == 0.5
    nothing = models.fit_text_classifier(df.limit(0))
    assert models.classify(df, nothing, "i").count() == 6


@pytest.mark.parametrize("counted", [True, False])
def test_classify_shuffles_no_common_word(spark, monkeypatch, counted):
    """All weights sent to the tasks, or only the commonest; texts that share a key count together."""
    rows = [(i, f"the w{i % 9} w{i % 4} the", i % 2) for i in range(40)] + [(7, "w1 new", None), (None, "the w2", 1), (90, None, None)]
    df = spark.createDataFrame(rows, "i int, text string, label int")
    weights = models.fit_text_classifier(df)
    weight = {r.word: r.weight for r in weights.collect()}
    table = weights if counted else weights.select("word", "weight")
    sums = Counter()
    for i, text, _ in rows:
        sums[i] += sum(weight.get(w, 0) for w in (text or "").split())
    want = []
    for i, _, _ in rows:
        odds = weight[None] + (sums[i] if i is not None else 0)
        want.append((i, "positive" if round(odds, 9) >= 0 else "negative", round(1 / (1 + math.exp(-abs(odds))), 6)))
    for most in (500_000, 3):
        monkeypatch.setattr(models, "MAX_HOT", most)
        found = models.classify(df, table, "i")
        assert sorted(map(str, ((r.i, r.label, round(r.score, 6)) for r in found.collect()))) == sorted(map(str, want))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [i#" in plan and not re.search(r"Aggregate \[i#\d+, word#", plan)


def test_verbs_are_looked_up_by_distinct_words(spark, monkeypatch):
    written, settle = [], verbs.settle
    monkeypatch.setattr(verbs, "settle", lambda df, label: written.append(settle(df, label)) or written[-1])
    rows = [(i, "he was lifting and lifted the lifts then fell ended") for i in range(50)] + [(3, "run and cut"), (None, "ran"), (60, None), (61, "none")]
    df = spark.createDataFrame(rows, "k int, t string")
    lexicon = spark.createDataFrame([("lift",), ("fall",), ("run",), ("cut",), (None,), ("lift",)], "base string")
    found = []
    for small in (100_000, 0):
        monkeypatch.setattr(verbs, "SMALL_LEXICON", small)
        got = verbs.text_verbs(df, "k", F.split("t", " "), lexicon, {"fell": "fall", "ran": "run"}).collect()
        found.append(sorted(str((r.k, r.verb, r.second_verb, r.n_verbs)) for r in got))
    assert found[0] == found[1] and len(found[0]) == 54 and "(None, None, None, 0)" in found[0] and "(61, None, None, 0)" in found[0]
    assert found[0].count("(1, 'lift', 'lift', 3)") == 1 and found[0].count("(3, 'lift', 'lift', 3)") == 2
    assert {r.word: (r.rank, r.form) for r in written[0].collect()} == {
        "lifting": (1, "lift"), "lifted": (1, "lift"), "lifts": (2, "lift"), "fell": (1, "fall"), "run": (2, "run"), "cut": (2, "cut"), "ran": (1, "run"),
    }


def test_project_from_a_table_name(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i % 2), f"free text {i}", [i]) for i in range(200)], "k int, c string, y double, t string, a array<int>")
    df.createOrReplaceTempView("lines_of_project")
    project = models.project_from_table(spark, "p", "lines_of_project", "y", "linear")
    assert project.table == "lines_of_project" and project.results[0][1] < 0.2
    assert "prediction" in project.champion.transform(df).columns
