"""Direction classifiers in time order: splits, folds, models, metrics, what-if tables, contributions."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import date as Date
from random import Random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.chunks import kept

# Fold sizes, pass line, parameters of the boosted trees.
FIRST, STEP, PASS_AUC = 500, 60, 0.52
TREES = {"maxDepth": 4, "stepSize": 0.05, "maxIter": 300, "subsamplingRate": 0.8, "seed": 42}
SPLIT_DATE = Date(2024, 1, 1)


def time_split(df: DataFrame, cut: Date = SPLIT_DATE, date: str = "date") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(date) < F.lit(cut)), df.where(F.col(date) >= F.lit(cut))


def numbered(df: DataFrame, date: str = "date", name: str = "row_no") -> DataFrame:
    """Rows of one training table numbered by date from 0; the numbers come from counts by date, so only those meet in one task."""
    days = df.groupBy(date).agg(F.count(F.lit(1)).alias("_n"))
    before = days.select(date, (F.sum("_n").over(Window.orderBy(date)) - F.col("_n")).alias("_b"))
    within = F.row_number().over(Window.partitionBy(date).orderBy(*([c for c in df.columns if c != date] or [date]))) - 1
    return df.withColumn("_i", within).join(before, date).withColumn(name, (F.col("_b") + F.col("_i")).cast("long")).drop("_i", "_b")


def expanding_folds(df: DataFrame, first: int = FIRST, step: int = STEP, index: str = "row_no") -> DataFrame:
    """fold: the full test block of a row (from 0), null before the first and in an unfinished last block."""
    n = df.agg(F.max(index)).first()[0]
    blocks = max(0, (0 if n is None else n + 1) - first) // step
    fold = F.floor((F.col(index) - first) / step).cast("int")
    return df.withColumn("fold", F.when((fold >= 0) & (fold < blocks), fold))


def time_cv(df: DataFrame, folds: int = 5, index: str = "row_no") -> DataFrame:
    """fold (1 to folds) of time-ordered cross-validation: test blocks of n div (folds + 1) rows; 0: training only."""
    n = (df.agg(F.max(index)).first()[0] or 0) + 1
    size = max(1, n // (folds + 1))
    start = n - folds * size
    return df.withColumn("fold", F.when(F.col(index) < start, 0).otherwise(F.floor((F.col(index) - start) / size) + 1).cast("int"))


def boosted_trees(features: list[str], label: str, **params) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), GBTClassifier(labelCol=label, featuresCol="features", **(TREES | params))])


def ensemble(features: list[str], label: str, trees: dict | None = None) -> list[Pipeline]:
    """Boosted trees, random forest and logistic regression."""
    assemble = VectorAssembler(inputCols=features, outputCol="features")
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    return [
        boosted_trees(features, label, **(trees or {})),
        Pipeline(stages=[assemble, RandomForestClassifier(labelCol=label, numTrees=100, maxDepth=5, seed=42)]),
        Pipeline(stages=[assemble, scaled, LogisticRegression(labelCol=label, featuresCol="scaled", regParam=0.01)]),
    ]


def fit_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """df to fit on: a table written once, dealt by its keys and sorted. Each round of boosting has a few short jobs, whose time is
    that of planning and sending tasks: so they get few parts, and nothing behind the shuffle is sent with them. Parts and order
    depend on the rows alone, so models with seeds do not change with the machine."""
    rows = kept(df)
    parts = min(FIT_PARTS, rows.count() // FIT_ROWS + 1)
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys)


#: Rows of a part of a table to fit on, and most parts.
FIT_ROWS, FIT_PARTS = 16_384, 256


def fit_all(pipelines: list[Pipeline], train: DataFrame) -> list[PipelineModel]:
    """Models in the order of their pipelines, fitted at the same time."""
    with ThreadPoolExecutor(max(1, len(pipelines))) as pool:
        return list(pool.map(lambda p: p.fit(train), pipelines))


def probability(models: list[PipelineModel], df: DataFrame, features: list[str], name: str = "probability_up") -> DataFrame:
    """df with the mean probability of class 1; a missing feature is an error."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    own = df.columns
    for i, m in enumerate(models):
        df = m.transform(df).withColumn(f"_p{i}", vector_to_array("probability")[1]).select(*own, *[f"_p{j}" for j in range(i + 1)])
    return df.withColumn(name, sum((F.col(f"_p{i}") for i in range(len(models))), F.lit(0.0)) / len(models)).select(*own, name)


def save_ensemble(models: list[PipelineModel], features: list[str], path: str) -> None:
    spark = SparkSession.active()
    for i, m in enumerate(models):
        m.write().overwrite().save(f"{path}/model-{i}")
    spark.createDataFrame([(len(models), features)], "models int, features array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/features")


def load_ensemble(spark, path: str, features: list[str] | None = None) -> tuple[list[PipelineModel], list[str]]:
    """Models and their feature order, which must equal the given one."""
    row = spark.read.schema("models int, features array<string>").json(f"{path}/features").first()
    if features is not None and list(features) != row["features"]:
        raise ValueError("the saved ensemble has other features")
    return [PipelineModel.load(f"{path}/model-{i}") for i in range(row["models"])], row["features"]


def exported_logistic(model: PipelineModel, features: list[str]) -> dict[str, float]:
    """Weights of the ensemble's logistic regression on unscaled features, the intercept under "": they score in any SQL."""
    scaler, fitted = model.stages[-2], model.stages[-1]
    share = [c / s if s else 0.0 for c, s in zip(fitted.coefficients, scaler.std)]
    return {"": float(fitted.intercept - sum(w * m for w, m in zip(share, scaler.mean)))} | {f: float(w) for f, w in zip(features, share)}


def weighted_probability(df: DataFrame, weights: dict[str, float], name: str = "probability_up") -> DataFrame:
    """df with the probability of exported weights; null where a feature is."""
    margin = sum((F.col(f) * F.lit(w) for f, w in weights.items() if f), F.lit(weights.get("", 0.0)))
    return df.withColumn(name, 1 / (1 + F.exp(-margin)))


def _ranked(by: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Mean rank r of each score, from n rows of each. Scores are cut in ranges, which are ranked apart and then moved up by
    the rows of the lower ranges of their key; so no task sees all scores."""
    cuts = by.select(F.percentile_approx(score, [i / RANGES for i in range(1, RANGES)], 1000).alias("cuts"))
    by = by.join(F.broadcast(cuts)).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col(score)))).drop("cuts")
    sizes = by.groupBy(*keys, "part").agg(F.sum("n").alias("rows"))
    low = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows of a key
    base = sizes.select(*keys, "part", F.coalesce(F.sum("rows").over(low), F.lit(0)).alias("base"))
    within = F.sum("n").over(Window.partitionBy(*keys, "part").orderBy(score)) - F.col("n")
    return by.withColumn("within", within).join(base, [*keys, "part"]).withColumn("r", F.col("base") + F.col("within") + (F.col("n") + 1) / 2)


#: Ranges of scores that are ranked apart.
RANGES = 64


def auc(df: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
    """(keys, auc) from ranks, ties averaged; null with one class. Scores are counted first, so ties cost nothing."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    by = rows.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("p"))
    ranked = _ranked(by, keys, score)
    pos, all_ = F.sum("p"), F.sum("n")
    value = F.try_divide(F.sum(F.col("r") * F.col("p")) - pos * (pos + 1) / 2, pos * (all_ - pos))
    return ranked.groupBy(*keys).agg(value.alias("auc"))


def metrics(df: DataFrame, predicted: str, label: str, keys: list[str]) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1; 0 where undefined."""
    def n(p: int, y: int):
        return F.count(F.when((F.col(predicted) == p) & (F.col(label) == y), 1))

    c = df.groupBy(*keys).agg(n(1, 1).alias("tp"), n(1, 0).alias("fp"), n(0, 1).alias("fn"), n(0, 0).alias("tn"))
    zero = F.lit(0.0)
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), zero)
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), zero)
    acc = F.coalesce(F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), zero)
    return c.withColumns({"accuracy": acc, "precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), zero)})


def walk_forward(df: DataFrame, features: list[str], label: str, make=boosted_trees, first: int = FIRST, step: int = STEP, parallel: int = 4, **params) -> DataFrame:
    """Predictions of every fold by a model of all earlier rows. df: with row_no. Folds are fitted from a thread pool."""
    data = kept(expanding_folds(df, first, step))  # the folds read it, not the windows behind it
    folds = [r[0] for r in data.select("fold").where("fold IS NOT NULL").distinct().orderBy("fold").collect()]

    def one(k: int) -> DataFrame:
        made = make(features, label, **params)
        models = fit_all(made if isinstance(made, list) else [made], data.where(F.col("row_no") < first + step * k))
        return probability(models, data.where(F.col("fold") == k), features)

    if not folds:
        raise ValueError("too few rows for a fold")
    with ThreadPoolExecutor(parallel) as pool:
        parts = list(pool.map(one, folds))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fold_summary(predictions: DataFrame, label: str) -> DataFrame:
    """AUC and accuracy per fold."""
    scored = predictions.withColumn("predicted", (F.col("probability_up") >= 0.5).cast("int"))
    return auc(scored, "probability_up", label, ["fold"]).join(metrics(scored, "predicted", label, ["fold"]), "fold")


def search_parameters(df: DataFrame, features: list[str], label: str, grid: dict[str, list], draws: int = 10, folds: int = 5, seed: int = 42) -> list[tuple[dict, float]]:
    """Seeded random draws from a grid by mean AUC over time-ordered folds, best first; folds of one class are skipped."""
    rng = Random(seed)
    data = kept(time_cv(df, folds))
    tried: list[tuple[dict, float]] = []
    for _ in range(draws):
        params = {k: rng.choice(v) for k, v in grid.items()}
        if any(p == params for p, _ in tried):
            continue
        found = []
        for k in range(1, folds + 1):
            train, test = data.where(F.col("fold") < k), data.where(F.col("fold") == k)
            if train.select(label).distinct().limit(2).count() < 2:
                continue
            scored = probability([boosted_trees(features, label, **params).fit(train)], test, features)
            a = auc(scored, "probability_up", label, []).first()
            if a and a[0] is not None:
                found.append(a[0])
        tried.append((params, sum(found) / len(found) if found else 0.0))
    return sorted(tried, key=lambda x: -x[1])


def what_if(df: DataFrame, features: list[str], score, keys: list[str], factors: Iterable[float] = (1.1, 0.9)) -> DataFrame:
    """(keys, feature, factor, base, new, change, flipped): each feature scaled alone.

    score: function from a DataFrame with the features to one with probability_up; it runs once over all variants.
    """
    variants = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(x).alias("factor")) for f in features for x in factors] + [F.struct(F.lit("").alias("feature"), F.lit(1.0).alias("factor"))]))
    rows = df.select(*keys, *features, variants.alias("_v"))
    changed = rows.select(*keys, "_v.feature", "_v.factor", *[(F.col(f) * F.when(F.col("_v.feature") == f, F.col("_v.factor")).otherwise(1.0)).alias(f) for f in features])
    scored = score(changed)
    base = F.max(F.when(F.col("feature") == "", F.col("probability_up"))).over(Window.partitionBy(*keys))
    out = scored.select(*keys, "feature", "factor", base.alias("base"), F.col("probability_up").alias("new")).where("feature <> ''")
    return out.withColumns({"change": F.col("new") - F.col("base"), "flipped": (F.col("new") >= 0.5) != (F.col("base") >= 0.5)})


def what_if_pairs(df: DataFrame, features: list[str], score, keys: list[str], factors: tuple[float, float] = (1.1, 0.9), flips: int = 5) -> DataFrame:
    """Pairs of features scaled together, all four sign pairs; the first flips of each key."""
    pairs = [(a, b, x, y) for i, a in enumerate(features) for b in features[i + 1 :] for x in factors for y in factors]
    tags = F.array(*[F.struct(F.lit(i).alias("pair_no"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(x).alias("fa"), F.lit(y).alias("fb")) for i, (a, b, x, y) in enumerate([("", "", 1.0, 1.0), *pairs])])
    rows = df.select(*keys, *features, F.explode(tags).alias("v")).select(*keys, *features, "v.*")
    changed = rows.withColumns({f: F.col(f) * F.when(F.col("a") == f, F.col("fa")).when(F.col("b") == f, F.col("fb")).otherwise(1.0) for f in features})
    base = F.max(F.when(F.col("pair_no") == 0, F.col("probability_up"))).over(Window.partitionBy(*keys))
    out = score(changed).withColumn("base", base).where((F.col("pair_no") > 0) & ((F.col("probability_up") >= 0.5) != (F.col("base") >= 0.5)))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("pair_no"))).where(F.col("rank") <= flips)
    return ranked.select(*keys, "rank", "a", "b", "fa", "fb", "base", F.col("probability_up").alias("new"))


def contributions(df: DataFrame, features: list[str], score, keys: list[str], means: dict[str, float] | None = None) -> DataFrame:
    """(keys, feature, contribution): change of probability when a feature takes its mean instead. Rows are dealt by their keys
    before they are multiplied and scored, so all cores score and no variant is sent."""
    means = means or df.agg(*[F.avg(f).alias(f) for f in features]).first().asDict()
    tags = F.explode(F.array(*map(F.lit, ["", *features])))
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = df.select(*keys, *features).repartition(parts, *keys).select(*keys, *features, tags.alias("feature"))
    changed = rows.withColumns({f: F.when(F.col("feature") == f, F.lit(means[f])).otherwise(F.col(f)) for f in features})
    base = F.max(F.when(F.col("feature") == "", F.col("probability_up"))).over(Window.partitionBy(*keys))
    return score(changed).select(*keys, "feature", (base - F.col("probability_up")).alias("contribution")).where("feature <> ''")


def importance(contributed: DataFrame, k: int = 10) -> DataFrame:
    """(feature, importance, rank) by mean absolute contribution."""
    by = contributed.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))
    return by.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))).where(F.col("rank") <= k)


def compare_rankings(rankings: dict[str, DataFrame], names: list[str], top: int = 5) -> DataFrame:
    """(feature, one rank per model, in_all: among the first `top` of every model)."""
    out = None
    for model, r in rankings.items():
        one = r.where(F.col("feature").isin(names)).select("feature", F.col("rank").alias(f"rank_{model}"))
        out = one if out is None else out.join(one, "feature", "full")
    ok = F.lit(True)
    for m in rankings:
        ok = ok & F.coalesce(F.col(f"rank_{m}") <= top, F.lit(False))
    return out.withColumn("in_all", ok)


def version_verdicts(rankings: dict[str, DataFrame], stronger: tuple[tuple[str, str], tuple[str, str]], new: tuple[str, list[str]], horizons: tuple[str, str], keep: int = 10, top: int = 5) -> DataFrame:
    """(question, subject, verdict) from rankings (feature, importance, rank) by model.

    stronger: (model, feature) before and after; confirmed if both are ranked and the later importance is higher. new: a
    model and its new features: keep up to rank `keep`, else review. horizons: two models: differ unless the first `top`
    features are the same in the same order; subject is how many they share. A ranking has at most some tens of rows.
    """
    spark = next(iter(rankings.values())).sparkSession

    def of(model: str, feature: str, name: str) -> DataFrame:
        return rankings[model].where(F.col("feature") == feature).agg(F.max("importance").alias(name))

    (m0, f0), (m1, f1) = stronger
    first = of(m0, f0, "a").join(of(m1, f1, "b")).select(F.lit("stronger").alias("question"), F.lit(f1).alias("subject"), F.when(F.col("b") > F.col("a"), "confirmed").otherwise("not confirmed").alias("verdict"))
    names = spark.createDataFrame([(f,) for f in new[1]], "subject string")
    ranked = names.join(rankings[new[0]].select(F.col("feature").alias("subject"), "rank"), "subject", "left")
    second = ranked.groupBy("subject").agg(F.min("rank").alias("rank")).select(F.lit("new").alias("question"), "subject", F.when(F.col("rank") <= keep, "keep").otherwise("review").alias("verdict"))
    a, b = (rankings[m].where(F.col("rank") <= top).select("feature", F.col("rank").alias(n)) for m, n in zip(horizons, ("ra", "rb")))
    both = a.join(b, "feature", "full").agg(F.count(F.col("ra") + F.col("rb")).alias("shared"), F.count(F.when(F.col("ra") == F.col("rb"), 1)).alias("alike"), F.count(F.lit(1)).alias("n"))
    third = both.select(F.lit("horizons").alias("question"), F.col("shared").cast("string").alias("subject"), F.when(F.col("alike") == F.col("n"), "equal").otherwise("differ").alias("verdict"))
    return first.unionByName(second).unionByName(third)


def experiments(df: DataFrame, features: list[str], label: str, cut: Date = SPLIT_DATE, first: int = FIRST, step: int = STEP, **params) -> list[dict]:
    """One row per experiment: single split and walk-forward, of boosted trees and of the ensemble."""
    train, test = time_split(df, cut)
    rows = []
    for name, make in (("boosted_trees", boosted_trees), ("ensemble", lambda f, y, **p: ensemble(f, y, p))):
        made = make(features, label, **params)
        scored = probability(fit_all(made if isinstance(made, list) else [made], train), test, features)
        single = auc(scored, "probability_up", label, []).first()[0]
        folds = [r["auc"] for r in auc(walk_forward(df, features, label, make, first, step, **params), "probability_up", label, ["fold"]).collect() if r["auc"] is not None]
        mean = sum(folds) / len(folds) if folds else None
        rows.append({"experiment": name, "auc_split": single, "auc_walk_forward": mean, "passed": mean is not None and mean >= PASS_AUC})
    return rows
