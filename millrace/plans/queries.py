"""Registered queries: each takes (session, folder) and returns a DataFrame.

Doubles are rounded once, at the very end, so that results can be compared
whatever the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import dates, rules, text, vectors, verbs
from millrace.operators import context, conversation, encode, glm, knn, large_fit, models, ranking, summary
from millrace.operators.percentile import exact_percentile
from millrace.operators.registry import Registry
from millrace.plans import abt
from millrace.session import durable_path, new_path, settle
from millrace.sources import fixtures, tables
from millrace.sources.batches import BatchTable
from millrace.streaming import scoring

YEAR_A, YEAR_B = 1997, 1998
EFFECTS = ["country_id", "nace_desc", "activity_desc"]
ONE_EFFECT = ["activity_desc"]
CITY_EFFECTS = ["country_id", "city", "nace_desc", "activity_desc"]  # a city lies in one country, which takes nothing further off
REGISTERED = ["activity_desc", "country_id"]  # the effect of each version in the registry
RESPONSE = "verified"
KEY = "ClaimNumber"
NOISE_LEVEL = 0.01
PROJECT_KEY = ["l_orderkey", "l_linenumber"]
QUESTION_CELLS = 1_000_000  # numbers in a block of questions

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6, columns: Sequence[str] | None = None) -> DataFrame:
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits) for c in names}) if names else df


def union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# -- scans, sinks, catalog -----------------------------------------------------------


@query
def csv_roundtrip(spark, folder):
    path = new_path(spark, "claims-csv")
    tables.write_csv(fixtures.claims(spark, folder), path)
    return rounded(tables.read_csv(spark, path, fixtures.CLAIM_SCHEMA))


@query
def register_tables(spark, folder):
    return tables.register_tables(spark, folder, max_len=8)


@query
def ctas_avg_city(spark, folder):
    result = avg_by_city(fixtures.emissions(spark, folder, YEAR_B))
    return rounded(tables.create_table_as(result, "avg_city_stored"))


@query
def promote_table(spark, folder):
    return rounded(tables.promote(tables.table(spark, folder, "customer"), "customer_promoted"))


@query
def sql_text(spark, folder):
    statement = """
        select o_orderpriority, count(*) as n_orders, avg(o_totalprice) as avg_price
        from {orders} where o_orderstatus = :status group by o_orderpriority
    """
    orders = tables.table(spark, folder, "orders")
    return rounded(tables.run_sql(spark, statement, {"status": "F"}, orders=orders))


@query
def column_info(spark, folder):
    return union([tables.column_info(tables.table(spark, folder, t), t) for t in tables.TABLES])


@query
def table_shape(spark, folder):
    return union([tables.table_shape(tables.table(spark, folder, t), t) for t in tables.TABLES])


@query
def head_n(spark, folder):
    orders = tables.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return tables.first_rows(orders, ["o_orderkey"], 5)


@query
def vector_ingest(spark, folder):
    """Vectors arrive as JSON text beside their content and are appended to a vector table."""
    arriving = (
        tables.table(spark, folder, "embeddings")
        .select("vec_id", F.to_json("embedding").alias("json"))
        .join(tables.table(spark, folder, "documents"), F.col("vec_id") == F.col("doc_id"))
    )
    path = new_path(spark, "vectors")
    rows = arriving.select(F.col("vec_id").alias("id"), F.col("text").alias("content"), vectors.pack(F.col("json")).alias("vector"))
    rows.write.mode("append").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rounded(stored.select("id", "content", F.size("vector").alias("n_dims"), total.alias("vector_sum")))


@query
def vector_ingest_batches(spark, folder):
    """The same rows in three batches with a commit each; one is sent twice, and one fails at first."""
    rows = tables.table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), vectors.pack(F.to_json("embedding")).alias("vector"))
    stored = BatchTable(spark, new_path(spark, "vector-batches"), rows.schema)
    broken = F.assert_true(F.col("id") < 100, "the batch fails half-way")
    for part in (0, 1, 2):
        batch = rows.filter(F.col("id") % 3 == part)
        if part == 1:
            try:
                stored.append(batch.filter(broken.isNull()), "1")
            except SparkRuntimeException:  # as meant
                pass
        for _ in range(1 + (part == 2)):
            stored.append(batch, f"{part}")
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rounded(stored.read().select("id", F.size("vector").alias("n_dims"), total.alias("vector_sum")))


@query
def html_items(spark, folder):
    pages = tables.table(spark, folder, "pages")
    return pages.select("page_id", F.posexplode(text.html_items(F.col("html"))).alias("item_no", "item"))


@query
def json_props(spark, folder):
    """Read a field out of JSON text, and write it as JSON again."""
    parsed = F.from_json("props", "k int")
    return tables.table(spark, folder, "events").select(
        "event_id", parsed.getField("k").alias("k"), F.to_json(parsed).alias("encoded")
    )


@query
def json_items(spark, folder):
    """Fields out of a JSON list of records, one row per record."""
    def record(name: str, description: str):
        return F.struct(F.col("p_partkey").alias("id"), F.col(name).alias("name"), F.col(description).alias("description"))

    body = F.to_json(F.struct(F.array(record("p_name", "p_type"), record("p_brand", "p_type")).alias("items")))
    arriving = tables.table(spark, folder, "part").select("p_partkey", body.alias("body"))
    items = F.from_json("body", "items array<struct<id: bigint, name: string, description: string>>").getField("items")
    return arriving.select("p_partkey", F.inline(items))


# -- row rules ------------------------------------------------------------------------


@query
def dedup_rows(spark, folder):
    return tables.table(spark, folder, "events").select("event_type", "user_id").dropDuplicates()


@query
def fill_replace(spark, folder):
    filled = rules.fill_missing(fixtures.claims(spark, folder))
    return rules.recode(filled, "Gender", "U", "S").select(KEY, "Gender", "MaritalStatus")


@query
def guarded_wages(spark, folder):
    claims = fixtures.claims(spark, folder)
    return rounded(claims.select(KEY, *_named(rules.wage_columns()), rules.total_dependents().alias("TotalDependents")))


def _named(columns: dict) -> list:
    return [c.alias(name) for name, c in columns.items()]


@query
def drop_prefix(spark, folder):
    dated = fixtures.claims(spark, folder).select(KEY, *_named(dates.date_parts()))
    return rules.drop_prefix(dated, "WeekdayOfAccident", keep=["WeekdayOfAccident_Encode"])


@query
def min_impute(spark, folder):
    test = fixtures.test_claims(spark, folder)
    return rounded(rules.replace_with_min(test, abt.COST).select(KEY, abt.COST))


@query
def clip_rules(spark, folder):
    claims = fixtures.claims(spark, folder).withColumns(dates.date_parts()).withColumns(dates.report_delay())
    cost = rules.clip(F.col("UltimateIncurredClaimCost"), high=rules.COST_CAP)
    return rounded(
        claims.select(
            KEY,
            "WeeksReportDelay",
            dates.year_report_delay().alias("YearReportDelay"),
            cost.alias("UltimateIncurredClaimCost"),
        )
    )


@query
def claim_number_int(spark, folder):
    return fixtures.claims(spark, folder).select(KEY, rules.claim_number_int().alias("ClaimNumberInt"))


@query
def column_roles(spark, folder):
    train = fixtures.train_claims(spark, folder)
    derived = (
        rules.fill_missing(train)
        .withColumns(rules.wage_columns())
        .withColumns(dates.date_parts())
        .withColumns(dates.report_delay())
        .withColumns({"ClaimNumberInt": rules.claim_number_int(), abt.LOG_COST: F.log1p(abt.COST)})
        .withColumn("TotalDependents", rules.total_dependents())
        .withColumns(rules.interaction_columns())
        .drop(KEY, "DateTimeOfAccident", "DateReported")
    )
    return rules.column_roles(derived, ["HoursWorkedPerWeek", "WeeklyWages", "HourlyWages", "ClaimNumberInt"])


# -- text and dates -------------------------------------------------------------------


@query
def keyword_flags(spark, folder):
    return fixtures.claims(spark, folder).select(KEY, *_named(text.keyword_flags()))


@query
def body_parts(spark, folder):
    found = text.body_parts(fixtures.claims(spark, folder))
    return found.select(KEY, "BodyParts", "BodyParts_Minor", "BodyParts_Minor2")


@query
def cause_of_injury(spark, folder):
    found = text.cause_of_injury(fixtures.claims(spark, folder)).withColumns(text.cause_flags())
    return found.select(KEY, "CauseOfInjury", "CauseOfInjury_Minor", "CD_drive", "CD_bend", "CD_burn")


@query
def document_verbs(spark, folder):
    """First and second verb of every document, with the base forms as a table."""
    docs = tables.table(spark, folder, "documents")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    lexicon = spark.createDataFrame([(b,) for b in verbs.bases()], "base string")
    return verbs.text_verbs(docs, "doc_id", words, lexicon)


@query
def wordlist_edit(spark, folder):
    """The edited word list, with the number of claims that hold each word as a token."""
    words = text.edited_word_list(
        F.split(F.lit(";".join(text.BODY_PARTS)), ";"), text.BODY_PARTS_ADDED, text.BODY_PARTS_REMOVED
    )
    listed = spark.range(1).select(F.posexplode(words).alias("position", "word"))
    tokens = fixtures.claims(spark, folder).select(
        F.explode(F.array_distinct(text.tokens(F.lower("ClaimDescription")))).alias("token")
    )
    # only listed tokens are shuffled, so at most one row per word is left to join
    found = tokens.join(F.broadcast(listed), F.col("token") == F.col("word"), "left_semi")
    used = found.groupBy("token").agg(F.count("*").alias("n"))
    counted = listed.join(used, F.col("token") == F.col("word"), "left")
    return counted.select("position", "word", F.coalesce("n", F.lit(0).cast("long")).alias("n_claims"))


@query
def date_parts(spark, folder):
    return fixtures.claims(spark, folder).select(KEY, *_named(dates.date_parts()))


@query
def report_delay(spark, folder):
    return fixtures.claims(spark, folder).select(KEY, *_named(dates.report_delay()))


@query
def log_cost(spark, folder):
    """Logarithms of both costs; the loss is known for train rows only."""
    claims = fixtures.claims(spark, folder)
    cost = rules.clip(F.col("UltimateIncurredClaimCost"), high=rules.COST_CAP)
    loss = F.when(F.col("split") == "train", F.log1p(cost))
    return rounded(claims.select(KEY, F.log1p(abt.COST).alias(abt.LOG_COST), loss.alias(abt.TARGET)), 8)


@query
def code_interactions(spark, folder):
    filled = rules.recode(rules.fill_missing(fixtures.claims(spark, folder)), "Gender", "U", "S")
    return filled.select(KEY, *_named(rules.interaction_columns()))


@query
def text_normalize(spark, folder):
    body = F.col("text")
    name = F.concat_ws(".", "lang", "source")
    return tables.table(spark, folder, "documents").select(
        "doc_id",
        text.newline_to_blank(body).alias("one_line"),
        text.collapse(body).alias("collapsed"),
        F.lower(F.split_part(name, F.lit("."), F.lit(1))).alias("library"),
        text.capitalise(F.split_part(name, F.lit("."), F.lit(2))).alias("table_name"),
        text.to_base64(body).alias("encoded"),
    )


@query
def word_rows(spark, folder):
    return conversation.word_rows(tables.table(spark, folder, "conversations"))


# -- aggregates and encodings ---------------------------------------------------------


def avg_by_city(emissions: DataFrame) -> DataFrame:
    return emissions.groupBy("city").agg(F.avg(RESPONSE).alias("avg_verified"))


@query
def avg_city_2021(spark, folder):
    return rounded(avg_by_city(fixtures.emissions(spark, folder, YEAR_A)))


@query
def avg_city_2022(spark, folder):
    return rounded(avg_by_city(fixtures.emissions(spark, folder, YEAR_B)))


@query
def avg_only_2022(spark, folder):
    return rounded(avg_by_city(fixtures.emissions(spark, folder, YEAR_B)).select("avg_verified"))


def _both_sets(spark, folder, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same work on train and on test, each by its own statistics."""
    claims = fixtures.claims(spark, folder).drop("UltimateIncurredClaimCost")
    return union(
        [work(claims.filter(F.col("split") == s)).withColumn("split", F.lit(s)) for s in ("train", "test")]
    )


@query
def std_by_year(spark, folder):
    def work(claims):
        dated = claims.withColumn(abt.YEAR, F.year("DateTimeOfAccident"))
        by_year = encode.moments(dated, [abt.YEAR], [abt.COST])
        scored = encode.apply_year_standard(dated, by_year, abt.COST, "InitialIncurred_std")
        return scored.select(KEY, abt.YEAR, "InitialIncurred_std")

    return rounded(_both_sets(spark, folder, work))


@query
def center_columns(spark, folder):
    def work(claims):
        ready = (
            claims.withColumns(rules.wage_columns())
            .withColumns(dates.report_delay())
            .withColumn("ClaimNumberInt", rules.claim_number_int())
        )
        centred = encode.centred_columns(encode.moments(ready, [], encode.CENTRED), encode.CENTRED)
        return ready.select(KEY, *_named(centred))

    return rounded(_both_sets(spark, folder, work))


@query
def severity_flag(spark, folder):
    def work(claims):
        ready = claims.withColumn(abt.LOG_COST, F.log1p(abt.COST))
        limit = exact_percentile(ready, abt.LOG_COST, 0.95)
        return ready.select(
            KEY,
            encode.severity_flag(F.col(abt.LOG_COST), limit).alias("Severity_Ind"),
            F.lit(limit).alias("threshold"),
        )

    return rounded(_both_sets(spark, folder, work), 8)


def _text_features(claims: DataFrame) -> DataFrame:
    return text.cause_of_injury(text.body_parts(rules.fill_missing(claims)))


@query
def rare_level(spark, folder):
    """Kept causes come from the train rows and are applied to all."""
    claims = settle(_text_features(fixtures.claims(spark, folder)).select(KEY, "split", abt.CAUSE), "causes")
    counts = claims.filter("split = 'train'").groupBy(abt.CAUSE).agg(F.count("*").alias("n"))
    kept = settle(encode.fit_rare_levels(counts, abt.CAUSE), "kept")
    return encode.apply_rare_levels(claims, kept, abt.CAUSE).select(KEY, "split", abt.CAUSE)


def _encoded(spark, folder, splits: Sequence[str], noise_level: float = 0.0, seed: int = 0) -> DataFrame:
    """Smoothed target encodings of the sets, fitted on train in one grouped pass; texts are looked at once."""
    keys = list(abt.ENCODINGS)
    claims = fixtures.claims(spark, folder).filter(F.col("split").isin("train", *splits))
    cost = rules.clip(F.col("UltimateIncurredClaimCost"), high=rules.COST_CAP)
    rows = _text_features(claims).withColumn(abt.TARGET, F.when(F.col("split") == "train", F.log1p(cost)))
    rows = settle(rows.select(KEY, "split", *keys, abt.TARGET), "encoded-keys")
    fitted = abt.fit_train(settle(encode.moments(rows.filter("split = 'train'"), keys, [abt.TARGET]), "cells"))
    out = encode.apply_rare_levels(rows.filter(F.col("split").isin(*splits)), fitted.kept(), abt.CAUSE)
    for i, (column, name) in enumerate(abt.ENCODINGS.items()):
        out = encode.apply_target_encoding(
            out, fitted.of(column), column, name, fitted.prior, noise_level, seed + i, KEY
        )
    return out.select(KEY, "split", *abt.ENCODINGS.values())


@query
def target_encode(spark, folder):
    return rounded(_encoded(spark, folder, ["train"]).drop("split"))


@query
def target_encode_test(spark, folder):
    return rounded(_encoded(spark, folder, ["test"]).drop("split"))


@query
def encode_noise(spark, folder):
    """Encodings with noise, on train and on test."""
    return rounded(_encoded(spark, folder, ["train", "test"], NOISE_LEVEL, models.SEED))


@query
def frequency_encode(spark, folder):
    """Counts of the train rows, applied to all; a level unseen in train gives 1."""
    claims = text.body_parts(fixtures.claims(spark, folder))
    levels = settle(
        claims.filter("split = 'train'").groupBy("BodyParts").agg(F.count("*").alias("n")), "counts"
    )
    done = encode.apply_frequency_encoding(claims, levels, "BodyParts", "BodyParts_counts")
    return done.select(KEY, "split", "BodyParts", "BodyParts_counts")


@query
def topk_by_task(spark, folder):
    """The five most active users per event type (ties by user)."""
    counts = tables.table(spark, folder, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("downloads"))
    best = ranking.top_per_group(counts, "event_type", [F.desc("downloads"), "user_id"])
    return best.select("event_type", "rank", "user_id", "downloads")


# -- base table -----------------------------------------------------------------------


@query
def abt_train(spark, folder):
    train, _ = abt.build_abt(fixtures.train_claims(spark, folder))
    path = durable_path(spark, "claims_losses")
    stored = tables.create_table_as(train, "claims_losses", path)
    return rounded(tables.promote_folder(spark, "claims_losses", path, stored.schema))


@query
def abt_test(spark, folder):
    learnt = abt.learn(fixtures.train_claims(spark, folder))
    return rounded(abt.test_table(fixtures.test_claims(spark, folder), learnt))


# -- class-effect models ----------------------------------------------------------------


def _year_cells(spark, folder, effects=EFFECTS) -> DataFrame:
    return glm.level_cells(fixtures.emissions(spark, folder, YEAR_A), effects, RESPONSE)


def _year_fit(spark, folder, effects=EFFECTS, selection: str | None = None) -> glm.Fit:
    return glm.fit(fixtures.emissions(spark, folder, YEAR_A), effects, RESPONSE, selection)


@query
def class_levels(spark, folder):
    return glm.class_levels(_year_cells(spark, folder), EFFECTS, RESPONSE)


@query
def glm_sscp(spark, folder):
    products = glm.cross_products(_year_cells(spark, folder), EFFECTS, RESPONSE).filter("n > 0")
    return rounded(products.select(*EFFECTS, "set_id", "n", "sum_y", "sum_yy"), 3)


@query
def glm_one_effect(spark, folder):
    estimates = glm.parameter_estimates(spark, _year_fit(spark, folder, ONE_EFFECT))
    return rounded(estimates.select("effect", "level", "df", "estimate"))


@query
def glm_fit_statistics(spark, folder):
    return rounded(glm.fit_table(spark, _year_fit(spark, folder, ONE_EFFECT)))


@query
def glm_fit(spark, folder):
    return rounded(glm.parameter_estimates(spark, _year_fit(spark, folder)))


@query
def glm_backward(spark, folder):
    return rounded(glm.selection_summary(spark, _year_fit(spark, folder, selection="BACKWARD")), 4)


@query
def glm_forward(spark, folder):
    return rounded(glm.selection_summary(spark, _year_fit(spark, folder, selection="FORWARD")), 4)


@query
def glm_anova(spark, folder):
    return rounded(glm.anova(spark, _year_fit(spark, folder, selection="BACKWARD")), 2)


@query
def glm_simple_steps(spark, folder):
    """The models without effects or with one on the way of both selections: parameters and SBC."""
    chosen = {m: _year_fit(spark, folder, selection=m) for m in ("BACKWARD", "FORWARD")}
    steps = [glm.simple_steps(spark, f).withColumn("method", F.lit(m)) for m, f in chosen.items()]
    return rounded(union(steps).select("method", "effects", "n_parameters", "sbc"), 4)


def _city_fit(spark, folder, effects: Sequence[str]):
    """A fit with one level for each city, solved in Spark whatever their number."""
    return large_fit.fit_cells(large_fit.used_cells(_year_cells(spark, folder, effects), effects, RESPONSE), effects)


@query
def glm_city_estimates(spark, folder):
    """Estimates and standard errors of the model with the city alone."""
    estimates = glm.parameter_estimates(spark, _city_fit(spark, folder, ["city"]))
    return rounded(estimates.select("effect", "level", "df", "estimate", "std_err"))


@query
def glm_city_totals(spark, folder):
    """Predicted totals per level of a model with the city beside other effects."""
    coefficients = settle(glm.parameter_estimates(spark, _city_fit(spark, folder, CITY_EFFECTS)), "coefficients")
    return _level_totals(spark, folder, coefficients, CITY_EFFECTS)


def _level_totals(spark, folder, coefficients: DataFrame, effects: Sequence[str]) -> DataFrame:
    """Rows and predicted total per level of the effects: least squares meets the observed totals, and only it does."""
    used = fixtures.emissions(spark, folder, YEAR_A).filter(F.col(RESPONSE).isNotNull())
    scored = glm.score(used, coefficients, effects)
    pairs = F.array(*[F.struct(F.lit(e).alias("effect"), F.col(e).alias("level")) for e in effects])
    levels = scored.select(F.explode(pairs).alias("p"), "predicted").groupBy("p.effect", "p.level")
    return rounded(levels.agg(F.count("*").alias("n"), F.sum("predicted").alias("total_predicted")), 3)


@query
def glm_fit_totals(spark, folder):
    """Predicted totals of the full model per level of each effect."""
    return _level_totals(spark, folder, glm.parameter_estimates(spark, _year_fit(spark, folder)), EFFECTS)


@query
def glm_published_totals(spark, folder):
    """The model that BACKWARD selects, stored, published, loaded by name and version, and applied."""
    registry = Registry(spark, new_path(spark, "registry"))
    chosen = _year_fit(spark, folder, selection="BACKWARD")
    path = registry.store_table(glm.parameter_estimates(spark, chosen), "reg_model")
    version = registry.register(path, "glm_back", "emissions", action="publish")
    return _level_totals(spark, folder, registry.published_table("emissions", "glm_back", version), chosen.effects)


def _stored_model(spark, folder) -> tuple[Registry, str]:
    registry = Registry(spark, new_path(spark, "registry"))
    estimates = glm.parameter_estimates(spark, _year_fit(spark, folder, ONE_EFFECT))
    return registry, registry.store_table(estimates, "reg_model")


@query
def glm_store(spark, folder):
    registry, _ = _stored_model(spark, folder)
    return rounded(registry.table("reg_model").select("effect", "level", "df", "estimate"))


@query
def model_registry(spark, folder):
    """Two models stored under one name, each registered: every version shows its own parameters."""
    registry = Registry(spark, new_path(spark, "registry"))
    for effect in REGISTERED:
        estimates = glm.parameter_estimates(spark, _year_fit(spark, folder, [effect]))
        registry.register(registry.store_table(estimates, "reg_model"), "glm_back", "emissions", force=True)
    entries = registry.entries()
    intercept = F.max(F.when(F.col("effect") == glm.INTERCEPT, F.col("estimate")))
    versions = []
    for version in range(1, len(REGISTERED) + 1):
        stored = spark.read.parquet(registry.version_path("emissions", "glm_back", version))
        facts = stored.agg(F.count("*").alias("n_parameters"), intercept.alias("intercept"))
        versions.append(facts.withColumn("version", F.lit(version)))
    shown = entries.join(F.broadcast(union(versions)), "version")
    return rounded(shown.select("project", "name", "version", "action", "n_parameters", "intercept"))


@query
def glm_score(spark, folder):
    registry, _ = _stored_model(spark, folder)
    scored = glm.score(fixtures.emissions(spark, folder), registry.table("reg_model"), ONE_EFFECT)
    return rounded(scored.select("l_orderkey", "l_linenumber", "activity_desc", "predicted"))


@query
def stream_published(spark, folder):
    """Line items arrive in two rounds; between them a second model is published, which scores the later round alone."""
    registry = Registry(spark, new_path(spark, "registry"))
    lines = tables.table(spark, folder, "lineitem")
    others = [tables.table(spark, folder, t) for t in ("part", "supplier", "nation")]
    source, checkpoint = new_path(spark, "arriving"), new_path(spark, "published-checkpoint")
    sink = BatchTable(
        spark, new_path(spark, "published-scores"), T._parse_datatype_string("l_orderkey long, l_linenumber int, predicted double, model_version int")
    )
    for round_no, effect in enumerate(REGISTERED):
        estimates = glm.parameter_estimates(spark, _year_fit(spark, folder, [effect]))
        registry.register(registry.store_table(estimates, "reg_model"), "glm_back", "emissions", force=True, action="publish")
        lines.filter(F.col("l_orderkey") % 2 == round_no).write.mode("append").parquet(f"{source}/lineitem.parquet")
        running = scoring.score_published(
            scoring.parquet_stream(spark, source, "lineitem", lines.schema),
            lambda arrived: fixtures.emissions_from(arrived, *others), registry, "emissions", "glm_back", sink, checkpoint,
        )
        running.awaitTermination()
    return rounded(sink.read())


@query
def stream_score(spark, folder):
    """The same scores for line items that arrive as a stream of files."""
    registry, _ = _stored_model(spark, folder)
    schema = tables.table(spark, folder, "lineitem").schema
    others = [tables.table(spark, folder, t) for t in ("part", "supplier", "nation")]
    sink, checkpoint = new_path(spark, "scored"), new_path(spark, "scored-checkpoint")
    running = scoring.score_stream(
        scoring.parquet_stream(spark, folder, "lineitem", schema),
        lambda lines: fixtures.emissions_from(lines, *others),
        registry.table("reg_model"),
        ONE_EFFECT,
        sink,
        checkpoint,
    )
    running.awaitTermination()
    return rounded(spark.read.parquet(sink).select("l_orderkey", "l_linenumber", "activity_desc", "predicted"))


# -- projects and text models -------------------------------------------------------------


def _project(spark, folder, template: str = "standard") -> models.Project:
    return models.create_project(
        fixtures.emissions(spark, folder),
        "emissions_project",
        template,
        "public.emissions",
        RESPONSE,
        classes=EFFECTS,
        numbers=["year_comp"],
        key=PROJECT_KEY,
    )


@query
def automl_leaderboard(spark, folder):
    return rounded(models.leaderboard(spark, _project(spark, folder)), 4)


@query
def automl_folds(spark, folder):
    """Cross-validated errors of the candidates with a closed form, the city with its many levels among them."""
    return rounded(models.fold_errors(fixtures.emissions(spark, folder), RESPONSE, [*EFFECTS, "city"], PROJECT_KEY))


@query
def automl_manage(spark, folder):
    """Actions on a running, a failed and a finished project; the published champion is loaded and applied."""
    project = _project(spark, folder, "linear")
    registry = Registry(spark, new_path(spark, "projects"))
    registry.store_model(project.champion, project.name)
    done = []
    for state, action in [("running", "register"), ("failed", "publish"), *[(project.state, a) for a in ("register", "publish", "remove")]]:
        registry.set_state(project.name, state)
        done.append(registry.manage(project.name, action))
    champion = registry.published_model(project.name, project.name)
    fitted = fixtures.emissions(spark, folder).filter(models.train_part(PROJECT_KEY) & F.col(RESPONSE).isNotNull())
    scored = champion.transform(fitted).agg(F.count("*").alias("n_scored"), F.avg("prediction").alias("mean_predicted"))
    scored = scored.withColumn("scored_message", F.lit("Publish done"))
    return rounded(union(done).join(F.broadcast(scored), F.col("message") == F.col("scored_message"), "left").drop("scored_message"), 4)


@query
def text_classify(spark, folder):
    """A classifier learnt from the labelled documents, applied to all of them."""
    documents = tables.table(spark, folder, "documents")
    labelled = documents.join(tables.table(spark, folder, "labels"), "doc_id").select("text", F.col("quality").alias("label"))
    weights = settle(models.fit_text_classifier(labelled), "word-weights")
    return rounded(models.classify(documents.select("doc_id", "text"), weights, "doc_id"), 4)


@query
def extractive_summary(spark, folder):
    return summary.extractive_summary(tables.table(spark, folder, "documents"))


@query
def free_summary(spark, folder):
    """Every document summed up in its own sentences, without a given number of points."""
    return summary.free_summary(tables.table(spark, folder, "documents"))


# -- vectors, context, conversations ------------------------------------------------------


@query
def knn_single(spark, folder):
    """Nearest vectors to one question, the mean of all stored vectors, with their content."""
    stored = tables.table(spark, folder, "embeddings")
    question = knn.mean_vector(stored, "embedding").first().embedding
    hits = settle(knn.top_k_single(stored, question, 3), "hits")
    return rounded(context.with_content(hits, tables.table(spark, folder, "documents"), "vec_id", "doc_id", "text"))


def _topic_questions(spark, folder) -> DataFrame:
    """One question per label: its mean vector and a text."""
    topics = knn.mean_vector(tables.table(spark, folder, "embeddings"), "embedding", "label")
    return settle(
        topics.select(
            F.col("label").alias("question_id"),
            F.concat(F.lit("Which passages are about\ntopic "), F.col("label"), F.lit("?")).alias("query"),
            F.col("embedding").alias("question_vector"),
        ),
        "questions",
    )


def _hits(spark, folder, questions: DataFrame, k: int = 3) -> DataFrame:
    return knn.top_k(tables.table(spark, folder, "embeddings"), questions, k)


@query
def knn_batch(spark, folder):
    return rounded(_hits(spark, folder, _topic_questions(spark, folder), 5))


@query
def knn_by_id(spark, folder):
    """The three best other vectors of every twentieth vector, several blocks of questions."""
    stored = tables.table(spark, folder, "embeddings")
    questions = stored.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("question_vector"))
    hits = knn.top_k(stored, questions, 4, max_cells=QUESTION_CELLS).filter("question_id <> vec_id")
    order = Window.partitionBy("question_id").orderBy("rank")
    return rounded(hits.withColumn("rank", F.row_number().over(order)).filter("rank <= 3"))


def _contexts(spark, folder, questions: DataFrame) -> DataFrame:
    hits = settle(_hits(spark, folder, questions), "hits")
    documents = tables.table(spark, folder, "documents")
    return context.context(context.with_content(hits, documents, "vec_id", "doc_id", "text"), "question_id", "vec_id")


@query
def rag_context(spark, folder):
    return _contexts(spark, folder, _topic_questions(spark, folder))


@query
def rag_prompt(spark, folder):
    questions = _topic_questions(spark, folder)
    return context.prompts(_contexts(spark, folder, questions), questions, "question_id", "query")


@query
def chat_history(spark, folder):
    return conversation.history(tables.table(spark, folder, "conversations"))


@query
def chat_transcript(spark, folder):
    return conversation.transcript(tables.table(spark, folder, "conversations"))


@query
def token_usage(spark, folder):
    return rounded(conversation.token_usage(tables.table(spark, folder, "conversations")), 8)
