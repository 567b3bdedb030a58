import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, rules, text, verbs
from millrace.plans.oracles import _verb_forms
from millrace.sources import fixtures


def one(df):
    return df.first().asDict()


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def test_fill_touches_text_only(spark):
    df = spark.createDataFrame([(None, None, 1)], "a string, b double, i int")
    assert one(rules.fill_missing(df)) == {"a": "S", "b": None, "i": 1}


def test_guarded_ratio_does_not_raise_on_zero(spark):
    df = spark.createDataFrame(
        [(100.0, 0.0, 0, 1), (100.0, 4.9, 5, 2), (100.0, 5.0, 5, 3), (100.0, 100.0, 5, 4), (100.0, 100.1, None, 5)],
        "WeeklyWages double, HoursWorkedPerWeek double, DaysWorkedPerWeek int, i int",
    ).withColumns(rules.wage_columns())
    assert column(df, "HourlyWages") == [-1.0, -1.0, 20.0, 1.0, -1.0]
    assert column(df, "DailyWages") == [-1.0, 20.0, 20.0, 20.0, -1.0]
    assert column(df, "AnnualWages") == [5200.0] * 5


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None, 1), (-3, 2), (7, 3)], "x int, i int")
    assert column(df.withColumn("x", rules.clip(F.col("x"), 0, 1)), "x") == [None, 0, 1]


def test_claim_number(spark):
    df = spark.createDataFrame([("WC0000012", 1), ("WC12345678901", 2), ("WCxx", 3)], "ClaimNumber string, i int")
    assert column(df.withColumn("n", rules.claim_number_int()), "n") == [12, 12345678901, None]


def test_unknown_code_is_null(spark):
    df = spark.createDataFrame(
        [("F", "M", "P", 1), ("X", "M", "P", 2), ("S", None, "F", 3)],
        "Gender string, MaritalStatus string, PartTimeFullTime string, i int",
    ).withColumns(rules.interaction_columns())
    assert column(df, "GenderMarital_int") == [4, None, None]
    assert column(df, "PartFullMarital_int") == [4, 4, None]


def test_min_of_the_others(spark):
    df = spark.createDataFrame([(1.0, 1), (7.0, 2), (3.0, 3), (None, 4)], "c double, i int")
    assert column(rules.replace_with_min(df, "c"), "c") == [3.0, 7.0, 3.0, None]


def test_drop_prefix(spark):
    df = spark.createDataFrame([(1, 2, 3)], "WeekdayA int, WeekdayB int, x int")
    assert rules.drop_prefix(df, "Weekday", keep=["WeekdayB"]).columns == ["WeekdayB", "x"]


def test_column_roles(spark):
    df = spark.range(200).select(
        F.col("id").cast("string").alias("many"),
        (F.col("id") % 25).cast("string").alias("limit"),
        (F.col("id") % 26).cast("string").alias("over"),
        F.col("id").alias("n"),
        F.col("id").alias("TotalCost"),
        F.col("id").alias("binned"),
    )
    got = {r.column_name: r for r in rules.column_roles(df, ["binned"]).collect()}
    assert [c for c in got if got[c].is_cat] == ["limit"]
    assert got["limit"].n_levels == 25 and got["over"].n_levels is None
    assert [c for c in got if got[c].is_num] == ["n", "binned"]
    assert [c for c in got if got[c].is_num_nobins] == ["n"]


def test_dates(spark):
    df = spark.createDataFrame(
        [
            (dt.datetime(2001, 12, 31, 23, 59), dt.date(2002, 1, 1), 1),
            (dt.datetime(2001, 1, 1), dt.date(2003, 1, 1), 2),
            (dt.datetime(2001, 1, 7), dt.date(2001, 1, 1), 3),
        ],
        "DateTimeOfAccident timestamp_ntz, DateReported date, i int",
    ).withColumns(dates.date_parts())
    df = df.withColumns(dates.report_delay()).withColumn("d", dates.year_report_delay())
    assert column(df, "DaysReportDelay") == [1, 730, -6]
    assert column(df, "WeeksReportDelay") == [0, 55, -1]
    assert column(df, "WeekdayOfAccident") == ["Monday", "Monday", "Sunday"]
    assert column(df, "QuarterOfAccident") == [4, 1, 1]
    assert column(df, "HourOfAccident") == [23, 0, 0]
    assert column(df, "d") == [1, 1, 0]


def texts(spark, *values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "ClaimDescription string, i int")


def test_stress_at_the_start_does_not_count(spark):
    df = texts(spark, "STRESS", "WORKPLACE STRESS", "ACUTE STRESS", "CALM").withColumns(text.keyword_flags())
    assert column(df, "CD_WORKPLACE_STRESS") == [0, 1, 1, 0]


def test_flags_are_substrings_and_case_sensitive(spark):
    df = texts(spark, "LACERATION OF EYELID", "eye", "BRIGHT", "SOFT  TISSUE").withColumns(text.keyword_flags())
    assert column(df, "CD_EYE") == [1, 0, 0, 0]
    assert column(df, "CD_LACERAT_") == [1, 0, 0, 0]
    assert column(df, "CD_LEFT_RIGHT") == [0, 0, 1, 0]
    assert column(df, "CD_SOFT_TISSUE_") == [0, 0, 0, 0]
    assert len(text.keyword_flags()) == 23 and "CD_lift" not in text.cause_flags()


def test_tokens(spark):
    df = texts(spark, "  A\t B C \n", "", "   ", None).withColumn("t", text.tokens(F.col("ClaimDescription")))
    assert column(df, "t") == [["A", "B", "C"], [], [], None]
    df = texts(spark, "  A\t B C \n").withColumn("t", text.collapse(F.col("ClaimDescription")))
    assert column(df, "t") == ["A B C"]


def test_body_parts_follow_the_word_list(spark):
    df = text.body_parts(
        texts(
            spark,
            "WRIST AND HAND, HAND ARM",
            "KNEE",
            "BIG TOE",
            "foreign body",
            "FOREIGN BODY",
            "TRAUMA CARPEL",
            "CARPEL",
            "STRUCKED",
            "HIT BY TRUCK",
            "TOE ANKLE BACK ARM",
        )
    )
    got = [tuple(r) for r in df.orderBy("i").select("BodyParts", "BodyParts_Minor", "BodyParts_Minor2").collect()]
    unknown = ("Unknown", "Unknown")
    assert got == [
        ("arm", "hand", "wrist"),
        ("knee", *unknown),
        ("toe", *unknown),
        ("Unknown", *unknown),
        ("foreign_body", *unknown),
        ("stress", *unknown),
        ("wrist", *unknown),
        ("Unknown", *unknown),
        ("external", *unknown),
        ("ankle", "arm", "back"),
    ]


def test_second_tagger_counts_only_without_a_first_one(spark):
    df = text.cause_of_injury(texts(spark, "CUT FINGER FELL", "CUT FINGER STRAIN", "FELT PAIN", "NOTHING", "FELL AND SLIPPED"))
    got = [tuple(r) for r in df.orderBy("i").select("CauseOfInjury", "CauseOfInjury_Minor").collect()]
    assert got == [("fall", "Unknown"), ("cut", "strain"), ("feel", "Unknown"), ("Unknown", "Unknown"), ("fall", "slip")]


def test_fell_is_recoded_when_a_verb_table_keeps_it(spark):
    df = text.cause_of_injury(texts(spark, "FELL"), irregular={"fell": "fell"})
    assert column(df, "CauseOfInjury") == ["fall"]


# Forms that the rules must lead to their verbs: endings, silent e, doubled consonants, irregular ones.
FORMS = """
falling fall; fallen fall; lifting lift; lifted lift; struck strike; striking strike; lacerated lacerate; removed remove;
burnt burn; burned burn; driving drive; driven drive; bent bend; bending bend; felt feel; twisted twist; slipped slip;
tripping trip; crushed crush; caught catch; carrying carry; carried carry; pushing push; pulled pull; hitting hit; climbed climb;
jumping jump; cutting cut; loading load; unloading unload; moving move; using use; turned turn; dug dig; stepping step;
opening open; closing close; dropped drop; strained strain; bruised bruise; fractured fracture; lying lie; filling fill; seeing see
"""


def test_lemmas_by_rule(spark):
    pairs = [w.split() for w in FORMS.replace("\n", " ").split(";")]
    plain = [("cut", "2cut"), ("works", "2work"), ("pushes", "2push"), ("carries", "2carry"), ("dies", "2die"), ("bed", None), ("thing", None), ("unspecified", None), ("ing", None), ("", None)]
    rows = [(f, f"1{lemma}") for f, lemma in pairs] + plain
    df = spark.createDataFrame(rows, "form string, want string")
    got = df.select("form", "want", verbs.lemma_in_row(F.col("form"), verbs.bases(), verbs.irregular_forms()).alias("lemma")).collect()
    assert [(r.form, r.lemma) for r in got] == rows
    assert {f: v for f, v in _verb_forms().items() if f in dict(rows)} == {f: v for f, v in rows if v}


@pytest.mark.parametrize("small", [100_000, 3])
def test_a_lexicon_table_gives_what_the_expression_gives(spark, monkeypatch, small):
    monkeypatch.setattr(verbs, "SMALL_LEXICON", small)
    texts_ = ["CUT FINGER FELL", "CUT FINGER STRAIN", "FELT PAIN", "NOTHING", "FELL AND SLIPPED", None, "", "lifting " * 500, "using used uses use", "work stress work"]
    df = spark.createDataFrame([*enumerate(texts_), (None, "fell")], "k int, ClaimDescription string").repartition(3)
    lexicon = spark.createDataFrame([(b,) for b in verbs.bases()] + [(None,), ("cut",)], "base string")
    words = F.split(F.lower("ClaimDescription"), " ")
    table = {r.k: (r.verb or "Unknown", r.second_verb or "Unknown") for r in verbs.text_verbs(df, "k", words, lexicon).collect()}
    row = {r.k: (r.CauseOfInjury, r.CauseOfInjury_Minor) for r in text.cause_of_injury(df).collect()}
    assert {k: v for k, v in table.items() if k is not None} == {k: v for k, v in row.items() if k is not None} and len(table) == len(row)
    assert {r.k: r.n_verbs for r in verbs.text_verbs(df, "k", words, lexicon).collect()}[7] == 500


def test_word_list_edit(spark):
    words = F.array(*[F.lit(w) for w in ("a", "b", "c")])
    df = spark.range(1).select(text.edited_word_list(words, ["c", "d"], ["a", "z"]).alias("w"))
    assert df.first().w == ["b", "c", "d"]
    kept = text.body_part_words()
    assert len(kept) == 161 and sum(" " not in w for w in kept) == 145


def test_template_values_are_not_filled_again(spark):
    df = spark.createDataFrame([("{b}", "x")], "a string, b string")
    filled = text.fill_template("<{a}|{b}|{c}|{a}>", {"a": F.col("a"), "b": F.col("b")})
    assert df.select(filled.alias("t")).first().t == "<{b}|x|{c}|{b}>"


def test_html_items(spark):
    html = "<ul><li class='k'><a href='#'>One</a></li>\n<li>T\nwo</li><link>no</link><li></li></ul>"
    df = spark.createDataFrame([(html,)], "h string").select(text.html_items(F.col("h")).alias("x"))
    assert df.first().x == ["one", "t\nwo", ""]
    loose = "<UL><LI id=a>One<li>two <b>x</b></UL> after <ol><li>three</LI ><li>four"
    df = spark.createDataFrame([(loose,), (None,), ("",)], "h string").select(text.html_items(F.col("h")).alias("x"))
    assert [r.x for r in df.collect()] == [["one", "two x", "three", "four"], None, []]


def test_capitalise_and_base64(spark):
    df = spark.createDataFrame([("éTUDE", "x" * 100)], "a string, b string")
    row = df.select(text.capitalise(F.col("a")).alias("a"), text.to_base64(F.col("b")).alias("b")).first()
    assert row.a == "Étude"
    assert "\n" not in row.b and len(row.b) == 136


def test_long_claim_numbers_are_not_cut(spark, tmp_path):
    rows = [(123456789012, 5, "F", 10.0, dt.datetime(1999, 1, 1), "1")]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/orders.parquet")
    assert fixtures.claims(spark, str(tmp_path)).first().ClaimNumber == "WC123456789012"
