"""Model templates, projects with a leaderboard, and a text classifier.

Classes enter a project's models by the mean target of their levels, kept as
a table, so features are as many as there are columns, however many levels
there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark import SparkContext, keyword_only
from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.rules import column_roles
from millrace.operators.cells import MAX_CELLS, Bins, CellLearner
from millrace.operators.common import least_common
from millrace.operators.levels import unpivot
from millrace.session import durable_path, settle

SEED = 9125
PRIOR_ROWS = 10.0  # rows of the overall mean that a level's mean is mixed with
FOLDS = 5
MAX_HOT = 500_000  # words whose weights are sent to every task
ROWS_A_PART = 400_000  # feature rows that a learner's task holds, about 0.2 KB each
CELLS_FROM = 2_000_000  # training rows beyond which trees are fitted on cells, of which there are fewer
WORD = r"[\p{L}\p{N}]+"
TEMPLATES = [
    ("linear", "Linear template", "One linear model on encoded classes", ["linear"]),
    ("trees", "Tree template", "Random forest and boosted trees", ["forest", "boosting"]),
    ("standard", "Standard template", "Linear model, random forest and boosted trees", ["linear", "forest", "boosting"]),
]


def templates(spark: SparkSession) -> DataFrame:
    """The templates a project can use: id, name, description."""
    return spark.createDataFrame([t[:3] for t in TEMPLATES], "id string, name string, description string")


def _learner(kind: str, binary: bool):
    common = {"featuresCol": "features", "labelCol": "label"}
    if kind == "linear":
        if binary:
            return LogisticRegression(regParam=0.01, maxIter=50, **common)
        return LinearRegression(regParam=0.01, **common)
    if kind == "forest":
        make = RandomForestClassifier if binary else RandomForestRegressor
        return make(numTrees=20, maxDepth=6, seed=SEED, **common)
    make = GBTClassifier if binary else GBTRegressor
    return make(maxIter=10, maxDepth=4, seed=SEED, **common)


def _without_summary(model: Model) -> Model:
    """A classifier without its training summary, which holds the session; tasks cannot be sent one that has observed a query."""
    if isinstance(model, LogisticRegressionModel) and model.hasSummary:
        model._java_obj.setSummary(SparkContext.getOrCreate()._jvm.scala.Option.empty())
    return model


class LevelMeans(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Class columns as numbers: the mean target of a row's level, from a table of all levels.

    The table is joined by hash, sent to the tasks or shuffled as its size
    asks, so a class may have any number of levels and none of them comes to
    the driver. A level that was not met in training, or null, gets the overall mean.
    """

    classes = Param(Params._dummy(), "classes", "class columns", TypeConverters.toListString)
    path = Param(Params._dummy(), "path", "place of the table of level means", TypeConverters.toString)
    overall = Param(Params._dummy(), "overall", "mean of levels that are not in the table", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, classes: list[str] | None = None, path: str | None = None, overall: float | None = None) -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        means = df.sparkSession.read.schema("effect string, level string, mean double").parquet(self.getOrDefault(self.path))
        for i, c in enumerate(self.getOrDefault(self.classes)):
            own = means.filter(F.col("effect") == c).select(F.col("level").alias(f"__level{i}"), F.col("mean").alias(f"__mean{i}"))
            df = df.join(own, F.col(c).cast("string") == F.col(f"__level{i}"), "left")
            df = df.withColumn(f"{c}__m", F.coalesce(f"__mean{i}", F.lit(self.getOrDefault(self.overall)))).drop(f"__level{i}", f"__mean{i}")
        return df


def fit_level_means(rows: DataFrame, classes: Sequence[str], label: str = "label", prior: float = PRIOR_ROWS) -> LevelMeans:
    """Mean of the label for every level of every class, mixed with ``prior`` rows of the overall mean; one grouped pass."""
    overall = rows.agg(F.avg(label)).first()[0] or 0.0
    levels = unpivot(rows.select(*[F.col(c).cast("string").alias(c) for c in classes], label), classes, label).filter("level is not null")
    sums = levels.groupBy("effect", "level").agg(F.count("*").alias("n"), F.sum(label).alias("s"))
    path = durable_path(rows.sparkSession, "level-means")
    sums.select("effect", "level", ((F.col("s") + F.lit(prior * overall)) / (F.col("n") + F.lit(prior))).alias("mean")).write.parquet(path)
    return LevelMeans(classes=list(classes), path=path, overall=float(overall))


def _features(rows: DataFrame, classes: Sequence[str], numbers: Sequence[str]) -> list[Transformer]:
    """Stages that make a row's features, fitted on some rows."""
    means = [fit_level_means(rows, classes)] if classes else []
    inputs = [*[f"{c}__m" for c in classes], *numbers]
    return [*means, VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")]


@dataclass
class Project:
    name: str
    template: str
    table: str
    target: str
    metric: str
    results: list[tuple[str, float]]  # best first
    champion: PipelineModel
    state: str = "completed"


def train_part(key: Sequence[str]) -> Column:
    """Whether a row is one of the seven in ten that models are fitted on, by md5 of its key."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10 < 7


def fold_of(key: Sequence[str], folds: int = FOLDS) -> Column:
    """The part of a row for cross-validation, by md5 of its key (other digits than ``train_part``)."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    return (F.conv(F.substring(digest, 9, 8), 16, 10).cast("long") % folds).cast("int")


def fold_errors(df: DataFrame, target: str, classes: Sequence[str], key: Sequence[str], folds: int = FOLDS) -> DataFrame:
    """Cross-validated error of the models with a closed form: the overall mean, and each class's level means.

    Rows (model, n, rmse, rank). One pass to moments by level and fold gives
    every model without a fold, and its error in that fold, since a squared
    error about any prediction is the spread plus the squared distance of the
    mean. A level that is met in one fold only, or null, is predicted by the
    overall mean of the other folds. Rows without target take no part.
    """
    rows = df.filter(F.col(target).isNotNull()).select(
        F.lit("").alias("__all"), *[F.col(c).cast("string").alias(c) for c in classes], F.col(target).cast("double").alias("y"), fold_of(key, folds).alias("fold")
    )
    cells = unpivot(rows, ["__all", *classes], "y", "fold").groupBy("effect", "level", "fold").agg(
        F.count("*").alias("n"), F.avg("y").alias("mean"), (F.var_pop("y") * F.count("*")).alias("css")
    )
    cells = settle(cells, "fold-cells")
    s = F.sum(F.col("n") * F.col("mean"))
    levels = cells.filter("level is not null").groupBy(F.col("effect").alias("e"), F.col("level").alias("l")).agg(F.sum("n").alias("tn"), s.alias("ts"))
    other = levels.filter("e = '__all'").select("tn", "ts").first()
    if other is None:
        return df.sparkSession.createDataFrame([], "model string, n long, rmse double, rank int")
    without = cells.filter("effect = '__all'").select(
        F.col("fold").alias("f"), F.try_divide(F.lit(other.ts) - F.col("n") * F.col("mean"), F.lit(other.tn) - F.col("n")).alias("base")
    )  # a row for each fold
    rest = F.try_divide(F.col("ts") - F.col("n") * F.col("mean"), F.col("tn") - F.col("n"))
    guess = F.coalesce(rest, F.col("base"))
    judged = cells.join(levels, (F.col("effect") == F.col("e")) & (F.col("level") == F.col("l")), "left").join(F.broadcast(without), F.col("fold") == F.col("f"))
    error = F.col("css") + F.col("n") * (F.col("mean") - guess) * (F.col("mean") - guess)
    found = judged.groupBy("effect").agg(F.sum("n").alias("n"), F.sqrt(F.sum(error) / F.sum("n")).alias("rmse"))
    name = F.when(F.col("effect") == "__all", "overall mean").otherwise(F.concat(F.lit("mean by "), "effect"))
    by_error = Window.orderBy("rmse", "model")  # a row for each class
    return found.select(name.alias("model"), "n", "rmse").withColumn("rank", F.row_number().over(by_error))


def project_from_table(
    spark: SparkSession, name: str, table: str, target: str, template: str = "standard", key: Sequence[str] = (), **options
) -> Project:
    """A project from the name of a table (``library.table``) and a target; roles come from the columns.

    Texts of few values are classes, numbers are numbers, other columns are
    left out. Without a key, rows are parted by all their plain columns.
    """
    df = spark.table(table)
    plain = [c for c, kind in df.dtypes if "<" not in kind]
    roles = column_roles(df.drop(target, *key), []).collect()
    classes, numbers = [r.column_name for r in roles if r.is_cat], [r.column_name for r in roles if r.is_num]
    return create_project(df, name, template, table, target, classes, numbers, key or plain, **options)


def dealt(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Stored rows in as many parts as their number asks for, ``most`` rows in each.

    Features of few values shrink to some bytes a row in a file, and files are
    cut by bytes; what a learner keeps of a row is many times that. A small
    table stays in the parts it is read in.
    """
    parts = -(-rows.count() // (most or ROWS_A_PART))
    if parts <= rows.rdd.getNumPartitions():
        return rows
    return rows.withColumn("__slot", F.monotonically_increasing_id()).repartition(parts, "__slot").drop("__slot")


def create_project(
    df: DataFrame,
    name: str,
    template: str,
    table: str,
    target: str,
    classes: Sequence[str],
    numbers: Sequence[str],
    key: Sequence[str],
    binary: bool = False,
) -> Project:
    """Fit every model of a template and keep the one with the least validation error.

    Rows are parted by a hash of their key, 7 to 3, which gives the same parts
    on every run and any cluster. All models share one prepared feature table.
    Beyond ``CELLS_FROM`` training rows the trees of a numeric target are
    fitted on cells, as long as there can be no more than ``MAX_CELLS``.
    """
    kinds = {t[0]: t[3] for t in TEMPLATES}
    if template not in kinds:
        raise ValueError(f"unknown template {template!r}; there are {sorted(kinds)}")
    rows = df.filter(F.col(target).isNotNull()).select(
        *classes,
        *[F.col(c).cast("double").alias(c) for c in numbers],
        F.col(target).cast("double").alias("label"),
        train_part(key).alias("train"),
    )
    stored = settle(rows, "project-rows")
    stages = _features(stored.filter("train"), classes, numbers)
    *means, assemble = stages
    large, learner = stored.filter("train").count() > CELLS_FROM, None
    if large and not binary and kinds[template] != ["linear"]:
        ready = settle(PipelineModel(stages=means).transform(stored).select(*assemble.getInputCols(), "label", "train"), "features")
        train, check = ready.filter("train"), ready.filter("not train")
        bins = Bins.of(train, assemble.getInputCols())
        if bins.cells <= MAX_CELLS:
            learner = CellLearner(bins, train, check, _learner("forest", binary).getNumTrees(), SEED)
        train, check = assemble.transform(train), assemble.transform(check)
        train = train if learner else dealt(train)
    else:
        # a small table as it comes, not as it was stored: its trees are sampled by part, so parts decide which rows they draw
        prepared = PipelineModel(stages=stages).transform(stored if large else rows).select("features", "label", "train")
        # even parts of a bounded size, as many as there are cores at least: every iteration runs over them
        ready = settle(prepared.hint("rebalance"), "features")
        train, check = dealt(ready.filter("train")), ready.filter("not train")
    if binary:
        judge = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC")
    else:
        judge = RegressionEvaluator(labelCol="label", metricName="rmse")
    tried = []
    for kind in kinds[template]:
        if learner and kind != "linear":
            model = learner.fit(_learner(kind, binary))
            tried.append((kind, learner.rmse(model), [*means, *bins.stages(), model]))
        else:
            model = _without_summary(_learner(kind, binary).fit(train))
            tried.append((kind, judge.evaluate(model.transform(check)), [*stages, model]))
    tried.sort(key=lambda t: -t[1] if judge.isLargerBetter() else t[1])
    champion = PipelineModel(stages=tried[0][2])
    metric = judge.getMetricName()
    return Project(name, template, table, target, metric, [(k, v) for k, v, _ in tried], champion)


def leaderboard(spark: SparkSession, project: Project) -> DataFrame:
    """Ranked models of a project, with the template's name and description."""
    lines = [
        (project.name, project.template, project.table, project.target, kind, project.metric, float(v), i, i == 1)
        for i, (kind, v) in enumerate(project.results, 1)
    ]
    schema = (
        "project string, id string, table_name string, target string, model string, "
        "metric string, value double, rank int, champion boolean"
    )
    board = spark.createDataFrame(lines, schema)
    return board.join(F.broadcast(templates(spark)), "id").withColumnRenamed("id", "template_id")


def _words(text: str) -> Column:
    return F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("word")


def fit_text_classifier(texts: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """Multinomial naive Bayes on words, labels 0 and 1: a table (word, weight, n), the prior under the null word.

    Every word keeps a weight of its own, the logarithm of its smoothed share
    in texts of label 1 over that in texts of label 0; ``n`` is how often it
    was met. One grouped pass; texts without a label are left out.
    """
    one, zero = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    counts = settle(texts.select(label, _words(text)).groupBy("word").agg(one.alias("one"), zero.alias("zero")).filter("one + zero > 0"), "word-counts")
    total = counts.agg(F.coalesce(F.sum("one"), F.lit(0)).alias("one"), F.coalesce(F.sum("zero"), F.lit(0)).alias("zero"), F.count("*").alias("n")).first()
    share = F.log((F.col("one") + 1.0) / (total.one + total.n)) - F.log((F.col("zero") + 1.0) / (total.zero + total.n))
    prior = texts.agg(F.log((one + 1.0) / (zero + 1.0)).alias("weight"))
    weights = counts.select("word", share.alias("weight"), (F.col("one") + F.col("zero")).alias("n"))
    return weights.unionByName(prior.select(F.lit(None).cast("string").alias("word"), "weight", F.lit(None).cast("long").alias("n")))


def classify(texts: DataFrame, weights: DataFrame, key: str, names: Sequence[str] = ("negative", "positive"), text: str = "text") -> DataFrame:
    """Label and its probability for every text, in batch; ``key`` tells texts apart. A text without known words gets the prior's.

    The weights of the commonest ``MAX_HOT`` words are sent to the tasks, which
    add them up where a text lies; only other words are looked up by shuffle.
    """
    prior = weights.filter("word is null").first().weight
    known, words = weights.filter("word is not null"), texts.select(key, _words(text))
    met = []
    if known.count() <= MAX_HOT:
        met.append(words.join(F.broadcast(known.select("word", "weight")), "word"))
    else:
        if "n" not in known.columns:
            known = settle(known.join(words.groupBy("word").agg(F.count("*").alias("n")), "word"), "word-weights")
        least = least_common(known, "n", 1, MAX_HOT)
        hot = F.broadcast(known.filter(F.col("n") >= least).select("word", "weight"))
        rare = known.filter(F.col("n") < least).select("word", "weight")
        met += [words.join(hot, "word"), words.join(hot, "word", "left_anti").join(rare, "word")]
    sums = reduce(DataFrame.unionAll, [m.select(key, "weight") for m in met]).groupBy(key).agg(F.sum("weight").alias("__sum"))
    odds = F.round(F.coalesce("__sum", F.lit(0.0)) + F.lit(prior), 9)  # a tie is one whatever the order of summation
    return texts.select(key).join(sums, key, "left").select(
        key,
        F.when(odds >= 0, names[1]).otherwise(names[0]).alias("label"),
        (1 / (1 + F.exp(-F.abs(odds)))).alias("score"),
    )
