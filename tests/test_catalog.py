import io
import os
import subprocess
import sys
import zipfile
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import session
from millrace.operators import commit_log, glm
from millrace.operators.registry import Registry
from millrace.plans import abt, queries
from millrace.sources import fixtures, tables
from millrace.sources.batches import BatchTable
from millrace.streaming import scoring


def test_shared_dir_is_the_named_one(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.settle(spark.range(5), "x").count() == 5


def test_the_package_is_shipped_as_a_zip(spark):
    path = session.ship(spark)
    assert session.ship(spark) == path  # the same content is stored once
    names = zipfile.ZipFile(io.BytesIO(session.package_zip())).namelist()
    assert {"millrace/__init__.py", "millrace/operators/glm.py"} <= set(names) and all(n.endswith(".py") for n in names)
    with zipfile.ZipFile(path.removeprefix("file:")) as archive:
        assert archive.namelist() == names


def test_invalid_names_are_reported(spark, tmp_path):
    for name in ("good", "toolongname", "9bad"):
        spark.range(3).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.name: r for r in tables.register_tables(spark, str(tmp_path), max_len=8).collect()}
    assert got["GOOD"].mapped and got["GOOD"].n_rows == 3 and got["GOOD"].reason is None
    assert not got["TOOLONGNAME"].mapped and "longer" in got["TOOLONGNAME"].reason
    assert not got["9BAD"].mapped and "valid" in got["9BAD"].reason
    assert spark.table("GOOD").count() == 3
    assert tables.register_tables(spark, str(tmp_path)).filter("mapped").count() == 2


def test_register_an_empty_folder(spark, tmp_path):
    assert tables.register_tables(spark, str(tmp_path)).count() == 0


def test_promoted_table_is_seen_by_other_sessions(spark):
    tables.promote(spark.range(4), "shared_numbers")
    assert spark.newSession().table("global_temp.shared_numbers").count() == 4


def test_a_promotion_outlives_the_application(spark):
    tables.promote(spark.range(4), "lasting")
    tables.promote(spark.range(6).withColumnRenamed("id", "n"), "lasting")
    code = """
import sys
from millrace.session import build
from millrace.sources import tables
spark = build("later", "local[1]", **{"spark.sql.warehouse.dir": sys.argv[1], "spark.ui.enabled": "false"})
print(tables.promoted(spark, "lasting").columns, spark.table("global_temp.lasting").count())
"""
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    env = {**os.environ, "PYTHONPATH": str(Path(session.__file__).parents[1])}
    later = subprocess.run([sys.executable, "-c", code, warehouse], env=env, capture_output=True, text=True, timeout=120)
    assert later.stdout.strip() == "['n'] 6", later.stderr[-2000:]
    tables.drop_promotion(spark, "lasting")
    for name in ("lasting", "never"):
        with pytest.raises(ValueError):
            tables.promoted(spark, name)


def test_create_table_replaces(spark):
    tables.create_table_as(spark.range(4), "t_replace")
    tables.create_table_as(spark.table("t_replace").filter("id > 1"), "t_replace")
    assert sorted(r.id for r in spark.table("t_replace").collect()) == [2, 3]


def test_sql_parameters_are_values(spark):
    df = spark.createDataFrame([("a' or '1'='1",), ("b",)], "s string")
    got = tables.run_sql(spark, "select * from {t} where s = :s", {"s": "a' or '1'='1"}, t=df)
    assert got.count() == 1


def test_csv_keeps_awkward_text(spark, tmp_path):
    df = spark.createDataFrame([('say "x", y\\', None), ("", "z")], "a string, b string")
    tables.write_csv(df.select("b", "a"), f"{tmp_path}/c")
    got = tables.read_csv(spark, f"{tmp_path}/c", "b string, a string")
    assert {(r.b) for r in got.collect()} == {None, "z"}
    assert 'say "x", y\\' in {r.a for r in got.collect()}


def test_registry(spark, tmp_path):
    registry = Registry(spark, str(tmp_path))
    path = registry.store_table(spark.range(2), "m")
    registry.store_table(spark.range(3), "m")
    assert registry.table("m").count() == 3
    assert registry.register(path, "m", "p") == 1
    with pytest.raises(ValueError):
        registry.register(path, "m", "p")
    assert registry.register(path, "m", "p", force=True) == 2
    assert registry.entries().count() == 2


def test_versions_keep_their_content(spark, tmp_path):
    registry = Registry(spark, str(tmp_path))
    for n, action in ((2, "register"), (5, "publish"), (7, "register")):
        registry.register(registry.store_table(spark.range(n), "m"), "m", "p", force=True, action=action)
    assert [spark.read.parquet(registry.version_path("p", "m", v)).count() for v in (1, 2, 3)] == [2, 5, 7]
    assert registry.published_table("p", "m").count() == registry.published_table("p", "m", 2).count() == 5
    for version in (1, 4):
        with pytest.raises(ValueError, match="no publish version"):
            registry.published_table("p", "m", version)


def test_two_writers_get_two_versions(spark, tmp_path):
    """Ten registrations from each of four writers at once: forty versions, none twice; a forced loser tries again."""
    writers = [Registry(spark, str(tmp_path)) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda i: writers[i % 4].register(f"path{i}", "m", "p", force=True), range(40)))
    assert sorted(got) == list(range(1, 41))
    assert {e["version"]: e["path"] for e in writers[0].versions()} == {v: f"path{i}" for i, v in enumerate(got)}
    late, first = Registry(spark, str(tmp_path)), writers[1]
    late.versions()
    asked = []

    def make(entries):  # someone else is first, between reading and writing
        if not asked:
            first.set_state("p", "completed")
        asked.append(len(entries))
        return {"what": "state", "project": "p", "state": f"seen {len(entries)}"}

    assert late.log.append(make)["state"] == f"seen {asked[1]}" and asked[1] == asked[0] + 1


def test_half_written_entries_say_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commit_log, "PATIENCE", 0.1)
    log = commit_log.CommitLog(spark, str(tmp_path / "log"))
    log.append(lambda _: {"n": 1})
    (tmp_path / "log" / "000000000002.json").write_text('{"n": 2')
    again = commit_log.CommitLog(spark, str(tmp_path / "log"))
    assert again.append(lambda entries: {"n": len(entries) + 2}) == {"n": 3}
    assert [e["n"] for e in again.entries()] == [1, 3]
    assert not commit_log.put_if_absent(spark, str(tmp_path / "log" / "000000000001.json"), "x")


def test_batches_count_once_and_whole(spark, tmp_path):
    rows = spark.range(100)
    stored = BatchTable(spark, str(tmp_path), rows.schema)
    assert stored.read().count() == 0
    assert stored.append(rows, "a") and not stored.append(rows, "a")
    with pytest.raises(SparkRuntimeException):
        stored.append(rows.repartition(5).filter(F.assert_true(F.col("id") != 77).isNull()), "b")
    assert stored.batches() == ["a"] and stored.read().count() == 100 and len(list((tmp_path / "data").iterdir())) == 1
    # another writer commits the batch while this one still writes it
    other = BatchTable(spark, str(tmp_path), rows.schema)
    mine = other.log.append
    other.log.append = lambda make: (stored.append(rows, "c"), mine(make))[1]
    assert not other.append(rows, "c") and other.read().count() == 200 and len(list((tmp_path / "data").iterdir())) == 2


def test_a_stream_follows_the_published_version(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "registry"))
    sink = BatchTable(spark, str(tmp_path / "sink"), T._parse_datatype_string("k string, predicted double, model_version int"))
    source = str(tmp_path / "in")

    def publish(*lines):
        table = spark.createDataFrame([("Intercept", "", 10.0), *lines], "effect string, level string, estimate double")
        registry.register(registry.store_table(table, "c"), "m", "p", force=True, action="publish")

    def run(checkpoint):
        stream = spark.readStream.schema("k string").parquet(source)
        scoring.score_published(stream, lambda df: df, registry, "p", "m", sink, str(tmp_path / checkpoint)).awaitTermination()

    publish(("k", "a", 1.0))
    spark.createDataFrame([("a",), ("b",)], "k string").coalesce(1).write.mode("append").parquet(source)
    run("one")
    publish(("k", "a", 2.0), ("k", "b", 3.0))
    registry.register("nowhere", "m", "p", force=True, action="register")  # not published, so not used
    spark.createDataFrame([("a",), ("b",)], "k string").coalesce(1).write.mode("append").parquet(source)
    run("one")
    want = [("a", 11.0, 1), ("a", 12.0, 2), ("b", None, 1), ("b", 13.0, 2)]
    assert sorted(map(tuple, sink.read().collect()), key=str) == sorted(want, key=str)
    publish(("k", "a", 9.0))
    run("two")  # a lost checkpoint: batch 0 is there already
    assert sink.read().count() == 4 and sink.batches() == ["0", "1"]


def test_a_project_that_failed_after_all_is_not_published(spark, tmp_path):
    registry = Registry(spark, str(tmp_path))
    for state in ("completed", "failed"):
        registry.set_state("p", state)
    assert registry.manage("p", "publish").first().message == "project is not completed: failed"


def test_stored_tables_lie_in_the_warehouse(spark):
    tables.create_table_as(spark.range(2), "t_lasting")
    tables.create_table_as(spark.range(3), "t_lasting")
    tables.create_table_as(spark.range(3).withColumnRenamed("id", "other"), "t_lasting")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    assert spark.table("t_lasting").columns == ["other"] and spark.table("t_lasting").count() == 3
    assert all(f.removeprefix("file://").startswith(warehouse) for f in spark.table("t_lasting").inputFiles())


def test_manage_needs_a_completed_project(spark, tmp_path):
    registry = Registry(spark, str(tmp_path))
    assert registry.manage("p", "register").first().error == "no project p"
    registry.set_state("p", "running")
    row = registry.manage("p", "register").first()
    assert row.error is None and "not completed" in row.message and row.version is None
    registry.set_state("p", "Completed")
    assert "invalid action" in registry.manage("p", "remove").first().error
    assert registry.manage("p", "register").first().version == 1
    assert registry.manage("p", "publish").first().version == 2


def test_stored_champion_scores_alike(spark, tmp_path):
    from millrace.operators import models

    df = spark.createDataFrame([(i, "ab"[i % 2], float(i % 2)) for i in range(200)], "k int, c string, y double")
    project = models.create_project(df, "p", "linear", "lib.t", "y", ["c"], [], ["k"])
    registry = Registry(spark, str(tmp_path))
    registry.store_model(project.champion, "p")
    a = project.champion.transform(df).agg(F.sum("prediction")).first()[0]
    assert registry.model("p").transform(df).agg(F.sum("prediction")).first()[0] == pytest.approx(a)


def test_stream_scores_late_files_once(spark, folder, tmp_path):
    """Two rounds over a growing folder: each file is scored once, as in batch."""
    lines = tables.table(spark, folder, "lineitem")
    others = [tables.table(spark, folder, t) for t in ("part", "supplier", "nation")]
    coefficients = session.settle(glm.parameter_estimates(spark, queries._year_fit(spark, folder, ["activity_desc"])), "c")
    source, sink, checkpoint = f"{tmp_path}/in/lineitem.parquet", f"{tmp_path}/out", f"{tmp_path}/check"
    for even in (True, False):
        lines.filter((F.col("l_orderkey") % 2 == 0) == even).write.mode("append").parquet(source)
        scoring.score_stream(
            scoring.parquet_stream(spark, f"{tmp_path}/in", "lineitem", lines.schema, max_files=1),
            lambda df: fixtures.emissions_from(df, *others),
            coefficients,
            ["activity_desc"],
            sink,
            checkpoint,
        ).awaitTermination()
    batch = glm.score(fixtures.emissions(spark, folder), coefficients, ["activity_desc"])
    streamed = spark.read.parquet(sink).select(batch.columns)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_year_filter_reaches_the_scan(spark, folder):
    plan = fixtures.emissions(spark, folder, 1997)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan


def test_base_table_contract(spark, folder):
    train, test = abt.build_abt(fixtures.train_claims(spark, folder), fixtures.test_claims(spark, folder), min_count=20)
    assert train.columns == abt.COLUMNS and len(train.columns) == 66
    assert test.columns == [c for c in abt.COLUMNS if c != "loss"]
    assert train.filter("CD_drive + CD_bend + CD_burn > 0").count() > 0
    assert train.count() == fixtures.train_claims(spark, folder).dropDuplicates().count()


def test_duplicate_claims_count_once(spark, folder):
    claims = fixtures.train_claims(spark, folder)
    once, _ = abt.build_abt(claims)
    twice, _ = abt.build_abt(claims.unionAll(claims))
    a, b = (df.agg(F.count("*"), F.round(F.sum("BodyPartsEncoding"), 6), F.sum("BodyParts_counts")).first() for df in (once, twice))
    assert a == b
