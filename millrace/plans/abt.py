"""Claims to analytic base table.

Each set is cleaned and given its row features once and written to the shared
folder. One grouped pass over that table yields the moments that all fits
need; the fits themselves run on those few rows. A last projection with
broadcast lookups of fitted values makes the result. So the data is shuffled
once (to drop duplicate rows) and read three times with pruned columns,
whatever the number of features.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import dates, rules, text
from millrace.operators import encode
from millrace.operators.percentile import exact_percentile
from millrace.session import settle

KEY = "ClaimNumber"
TARGET = "loss"
COST = "InitialIncurredCalimsCost"
LOG_COST = "LogInitialIncurredCalimsCost"
YEAR = "YearOfAccident"
CAUSE = "CauseOfInjury"
ENCODINGS = {
    "BodyParts": "BodyPartsEncoding",
    "BodyParts_Minor": "BodyPartsEncoding_Minor",
    "BodyParts_Minor2": "BodyPartsEncoding_Minor2",
    CAUSE: "CauseOfInjuryEncoding",
}
KEPT = "kept"  # marks the rows of the level table that list the kept causes
# The names and the order of the output columns.
COLUMNS = (
    """ClaimNumber Age Gender MaritalStatus DependentChildren DependentsOther WeeklyWages PartTimeFullTime
    HoursWorkedPerWeek DaysWorkedPerWeek InitialIncurredCalimsCost HourlyWages DailyWages AnnualWages
    ClaimNumberInt YearOfAccident MonthOfAccident DayOfAccident HourOfAccident QuarterOfAccident YearReported
    DaysReportDelay WeeksReportDelay LogInitialIncurredCalimsCost TotalDependents GenderMarital_int
    PartFullMarital_int""".split()
    + [f"CD_{w}" for w in text.KEYWORDS]
    + """CD_FOREIGN_BODY CD_BACK_STRAIN CD_SOFT_TISSUE_ CD_WORKPLACE_STRESS CD_LOWER_BACK_STRAIN CD_LEFT_RIGHT
    CD_LACERAT_ BodyParts BodyParts_Minor BodyParts_Minor2 CD_drive CD_bend CD_burn loss Severity_Ind
    InitialIncurred_std YearReportDelay BodyPartsEncoding BodyPartsEncoding_Minor BodyPartsEncoding_Minor2
    CauseOfInjuryEncoding BodyParts_counts Severity_Ind_Cat""".split()
)


def row_features(claims: DataFrame) -> DataFrame:
    """Fills, recodes and everything that a row tells by itself."""
    clean = rules.recode(rules.fill_missing(claims), "Gender", "U", "S")
    return (
        text.cause_of_injury(text.body_parts(clean))
        .withColumns(rules.wage_columns())
        .withColumns(dates.date_parts())
        .withColumns(dates.report_delay())
        .withColumns(
            {
                "ClaimNumberInt": rules.claim_number_int(),
                LOG_COST: F.log1p(COST),
                "TotalDependents": rules.total_dependents(),
                "YearReportDelay": dates.year_report_delay(),
            }
        )
        .withColumns(rules.interaction_columns())
        .withColumns(text.keyword_flags())
        .drop("DateTimeOfAccident", "DateReported", "ClaimDescription", "CauseOfInjury_Minor", "WeekdayOfAccident")
    )


def prepare_train(claims: DataFrame) -> DataFrame:
    capped = rules.clip(F.col("UltimateIncurredClaimCost"), high=rules.COST_CAP)
    base = row_features(claims.dropDuplicates()).withColumn(TARGET, F.log1p(capped))
    return settle(base.drop("UltimateIncurredClaimCost"), "claims-train")


def prepare_test(claims: DataFrame) -> DataFrame:
    """As for train, without a target, and with the marker cost replaced first."""
    replaced = rules.replace_with_min(claims.dropDuplicates(), COST, source=claims)
    return settle(row_features(replaced), "claims-test")


@dataclass
class Fitted:
    """What the train set teaches: one small table of levels, and the overall mean.

    Columns: feature, level, n, average (null where not asked for).
    """

    levels: DataFrame
    prior: float | None

    def kept(self) -> DataFrame:
        """Causes that stand on their own."""
        return self.levels.filter(F.col("feature") == KEPT).select(F.col("level").alias(CAUSE))

    def of(self, feature: str) -> DataFrame:
        return self.levels.filter(F.col("feature") == feature).withColumnRenamed("level", feature)


@dataclass
class SetStats:
    """What each set is standardised by: its own statistics."""

    by_year: DataFrame
    centred: dict[str, Column]
    severity: float | None


def set_stats(base: DataFrame, cells: DataFrame) -> SetStats:
    return SetStats(
        encode.roll_up(cells, [YEAR], [COST]),
        encode.centred_columns(encode.roll_up(cells, [], encode.CENTRED), encode.CENTRED),
        exact_percentile(base, LOG_COST, 0.95),
    )


def fit_train(cells: DataFrame, min_count: int = 100, min_samples_leaf: float = 100, smoothing: float = 10) -> Fitted:
    """All fits from the cells of the train set; nothing here reads the claims."""
    prior = encode.target_prior(cells, TARGET)
    causes = encode.roll_up(cells, [CAUSE], [])
    kept = encode.fit_rare_levels(causes, CAUSE, min_count)
    grouped = encode.apply_rare_levels(cells, kept, CAUSE)
    blank = F.lit(None).cast("double")
    levels = kept.select(F.lit(KEPT).alias("feature"), F.col(CAUSE).alias("level"), F.lit(0).cast("long").alias("n"), blank.alias("average"))
    average = encode.smoothed(TARGET, prior, min_samples_leaf, smoothing)
    for column in ENCODINGS:
        rows = encode.roll_up(grouped, [column], [TARGET], spread=False)
        levels = levels.unionAll(rows.select(F.lit(column), F.col(column), "n", average))
    return Fitted(settle(levels, "levels"), prior)


def train_cells(base: DataFrame) -> DataFrame:
    """Moments per year and combination of levels.

    Their number is bounded by the word list, the verb table and the years,
    not by the claims.
    """
    keys = [YEAR, "BodyParts", "BodyParts_Minor", "BodyParts_Minor2", CAUSE]
    return settle(encode.moments(base, keys, [COST, TARGET, *encode.CENTRED]), "cells")


def finish(base: DataFrame, fitted: Fitted, stats: SetStats, noise_level: float = 0.0, seed: int = 0) -> DataFrame:
    """Look up the fitted values and standardise."""
    out = encode.apply_rare_levels(base, fitted.kept(), CAUSE)
    out = out.withColumns(text.cause_flags(CAUSE))
    out = encode.apply_year_standard(out, stats.by_year, COST, "InitialIncurred_std")
    for i, (column, name) in enumerate(ENCODINGS.items()):
        out = encode.apply_target_encoding(out, fitted.of(column), column, name, fitted.prior, noise_level, seed + i, KEY)
    out = encode.apply_frequency_encoding(out, fitted.of("BodyParts"), "BodyParts", "BodyParts_counts")
    severity = encode.severity_flag(F.col(LOG_COST), stats.severity)
    out = out.withColumns({"Severity_Ind": severity, "Severity_Ind_Cat": severity.cast("string"), **stats.centred})
    return out.select(*[c for c in COLUMNS if c in out.columns])


@dataclass
class Learnt:
    """The prepared train set with its cells, and what was fitted on it."""

    base: DataFrame
    cells: DataFrame
    fitted: Fitted


def learn(train: DataFrame, min_count: int = 100) -> Learnt:
    base = prepare_train(train)
    cells = train_cells(base)
    return Learnt(base, cells, fit_train(cells, min_count))


def train_table(learnt: Learnt, noise_level: float = 0.0, seed: int = 0) -> DataFrame:
    return finish(learnt.base, learnt.fitted, set_stats(learnt.base, learnt.cells), noise_level, seed)


def test_table(test: DataFrame, learnt: Learnt, noise_level: float = 0.0, seed: int = 0) -> DataFrame:
    """Encodings and kept causes from train; severity, years and centring from the test set itself."""
    base = prepare_test(test)
    cells = settle(encode.moments(base, [YEAR], [COST, *encode.CENTRED]), "test-cells")
    return finish(base, learnt.fitted, set_stats(base, cells), noise_level, seed + len(ENCODINGS))


def build_abt(
    train: DataFrame, test: DataFrame | None = None, min_count: int = 100, noise_level: float = 0.0, seed: int = 0
) -> tuple[DataFrame, DataFrame | None]:
    """(train, test) base tables."""
    learnt = learn(train, min_count)
    done = train_table(learnt, noise_level, seed)
    return done, None if test is None else test_table(test, learnt, noise_level, seed)
