"""Model jobs on ``pyspark.ml``.

Feature preparation is a per-series window job (the same partitioning as
the time-series operators); training, cross-validation and scoring are
distributed ``pyspark.ml`` estimators.  Nothing is collected except model
metrics (a handful of numbers per fit).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRestModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import (MinMaxScaler, RobustScaler, StandardScaler, UnivariateFeatureSelector,
                                VectorAssembler, VectorSlicer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdant.functions import calendar as CAL
from verdant.functions import semantics as S
from verdant.functions.semantics import KEY, TS
from verdant.operators import features as FE
from verdant.operators.comoments import pair_correlations
from verdant.operators.day_features import by_day
from verdant.session import cut_lineage

# Fixed values of the reference: candidate model inputs, in order.
CANDIDATE_FEATURES = ["NDVI", "GNDVI", "NDWI_Gao", "EVI", "SAVI", "LAI", "T2M", "T2M_MAX", "T2M_MIN", "PRECTOTCORR",
                      "PET_PT_JPL", "VPD", "GDD", "water_balance_daily", "water_balance_7d", "water_balance_30d",
                      "NDVI_trend_slope", "NDVI_anomaly_std", "CWSI"]
LABEL = "water_stress_level"
TIME_FEATURES = ["year", "month", "day_of_year", "week_of_year", "season", "month_sin", "month_cos",
                 "day_of_year_sin", "day_of_year_cos"]


# ------------------------------------------------------------- M1 / F4 / F5 --

def fill_missing(df: DataFrame, cols, *, key=KEY, ts=TS) -> DataFrame:
    """F5 forward fill, then backward fill, then 0, per series by date.

    Where the forward fill is still NULL no earlier value exists, so the
    backward fill there is the series' first non-null value: a
    whole-partition aggregate under the same ascending order (one Window
    operator, no descending sort)."""
    whole_asc = S.ordered(key, ts).rowsBetween(S.Window.unboundedPreceding, S.Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(S.ffill(c, key, ts), F.first(c, ignorenulls=True).over(whole_asc),
                                         F.lit(0).cast(df.schema[c].dataType)) for c in cols})


WINDOWS, STATS = (3, 7, 14, 30), ("mean", "std", "min", "max")


def prepare_features(df: DataFrame, target: str = LABEL, lags=(1, 3, 7, 14), keep=(), *, key=KEY, ts=TS) -> DataFrame:
    """M1 model table: available candidate columns, time features, lags,
    rolling stats, interactions, the 0/1/2 label (X28) when absent, rows
    with a label only (F4), gaps filled (F5).  Returns (key, date, ``keep``
    columns as they are, features..., label).

    Narrow rows are shuffled by series; a task makes the table's some 400
    columns of one series after the other, and they are not shuffled or sorted.
    What needs a window over the series (splits, folds) is best put into
    ``keep``: a window over this table would shuffle all its columns."""
    avail = [c for c in CANDIDATE_FEATURES if c in df.columns]
    has_target = target in df.columns
    f = df.select(key, ts, *keep, *([target] if has_target else []), *[F.col(c).cast("double").alias(c) for c in avail])
    f = FE.interactions(f)
    if not has_target:
        f = FE.stress_label(f, LABEL)
        target = LABEL
    made = [c for c in f.columns if c not in (key, ts, *keep, target, *avail)]
    f = f.withColumn(target, F.col(target).cast("double"))
    past = [f"{c}_lag_{n}" for n in lags for c in avail] + [f"{c}_rolling_{a}_{w}" for w in WINDOWS for a in STATS for c in avail]
    kept, cols = [key, ts, *keep, target], [*avail, *past, *made]
    schema = T.StructType([*[f.schema[c] for c in kept], *[T.StructField(f"c{i}", T.DoubleType()) for i in range(len(cols))]])
    days = f.groupBy(key).applyInArrow(by_day(ts, target, kept, avail, made, lags, WINDOWS), schema)
    days = days.select(*kept, *[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
    times = [c for c in CAL.model_time_features(days.select(key, ts), ts).columns if c not in (key, ts)]
    return CAL.model_time_features(days, ts).select(key, ts, *keep, *times, *cols, F.col(target).alias("label"))


def feature_columns(df: DataFrame, key=KEY, ts=TS, target: str = "label") -> list[str]:
    return [c for c in df.columns if c not in (key, ts, target, "label", LABEL)]


# ------------------------------------------------------------------ T5 --

def temporal_split(df: DataFrame, test_size: float = 0.2, counted: str = "*", *, key=KEY, ts=TS) -> DataFrame:
    """T5 first ``1 - test_size`` of each series by date is train, the rest
    test (``is_train`` column).  ``counted``: the column whose values count, if
    the rows at the end of a series that lack it are left out later."""
    w = S.Window.partitionBy(key)
    rn = F.row_number().over(S.ordered(key, ts))
    n = F.count(counted).over(w)
    return df.withColumn("is_train", rn <= F.floor(n * (1 - test_size)))


def _draw(seed: int, key, ts):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key), F.col(ts).cast("string")))


def k_folds(df: DataFrame, folds: int = 5, seed: int = 42, *, key=KEY, ts=TS) -> DataFrame:
    """``fold`` 0..folds-1 by a hash of (key, date): the same rows each time,
    however the table is partitioned."""
    return df.withColumn("fold", (F.conv(F.substring(_draw(seed, key, ts), 1, 8), 16, 10).cast("bigint") % folds).cast("int"))


def stratified_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, label: str = "label", *, key=KEY, ts=TS) -> DataFrame:
    """``is_train`` with the same share of test rows of each class in each
    series; which rows is drawn by a hash of (key, date)."""
    w = S.Window.partitionBy(key, label)
    rank = F.row_number().over(w.orderBy(_draw(seed, key, ts)))
    return df.withColumn("is_train", rank > F.ceil(F.count("*").over(w) * test_size))


def forward_folds(df: DataFrame, n_splits: int = 3, *, key=KEY, ts=TS) -> DataFrame:
    """M4 expanding-window folds (TimeSeriesSplit): each series is cut in
    ``n_splits + 1`` consecutive blocks; fold i trains on blocks <= i and
    validates on block i + 1.  Adds ``block`` (0..n_splits)."""
    rn = F.row_number().over(S.ordered(key, ts)) - 1
    n = F.count("*").over(S.Window.partitionBy(key))
    test = F.floor(n / (n_splits + 1))
    first = n - test * n_splits
    block = F.when(rn < first, 0).otherwise(F.floor((rn - first) / test) + 1)
    return df.withColumn("block", F.least(block, F.lit(n_splits)).cast("int"))


# ---------------------------------------------------------------- M9 --

def scaler(method: str = "standard", input_col: str = "features", output_col: str = "scaled"):
    """M9 standard (centred, unit variance), min-max, or robust (median /
    IQR) scaling; centring is switched on explicitly."""
    if method == "standard":
        return StandardScaler(inputCol=input_col, outputCol=output_col, withMean=True, withStd=True)
    if method == "minmax":
        return MinMaxScaler(inputCol=input_col, outputCol=output_col)
    if method == "robust":
        return RobustScaler(inputCol=input_col, outputCol=output_col, withCentering=True, withScaling=True)
    raise ValueError(method)


def fit_scaling(df: DataFrame, cols, method: str = "standard", key: str | None = None) -> DataFrame:
    """M9 statistics to scale by: one row per key (one row in all without a
    key), columns ``<col>__mid`` and ``<col>__spread``.  Keep the result to scale
    other rows by the same statistics."""
    aggs = []
    for c in cols:
        if method == "standard":
            mid, spread = F.avg(c), F.stddev_pop(c)
        elif method == "minmax":
            mid, spread = F.min(c), F.max(c) - F.min(c)
        elif method == "robust":
            mid, spread = F.percentile(c, 0.5), F.percentile(c, 0.75) - F.percentile(c, 0.25)
        else:
            raise ValueError(method)
        aggs += [mid.alias(f"{c}__mid"), spread.alias(f"{c}__spread")]
    return (df.groupBy(key) if key else df.groupBy()).agg(*aggs)


def scale_columns(df: DataFrame, cols, method: str = "standard", key: str | None = None, stats: DataFrame | None = None,
                  suffix: str = "") -> DataFrame:
    """M9 columns scaled by ``stats`` (fitted on ``df`` if not given): population
    std, min/max, or median and IQR.  A constant column becomes 0 (robust: only
    centred).  Statistics are one aggregate, joined back on the key, or, without
    a key, one row of numbers; no window is involved."""
    stats = fit_scaling(df, cols, method, key) if stats is None else stats
    if key:
        told = df.join(stats, key, "left")
        mid, spread = (lambda c: F.col(f"{c}__mid")), (lambda c: F.col(f"{c}__spread"))
    else:
        row = stats.first()
        told = df
        mid, spread = (lambda c: F.lit(row[f"{c}__mid"])), (lambda c: F.lit(row[f"{c}__spread"]))
    out = {f"{c}{suffix}": F.when(spread(c) == 0, F.col(c) - mid(c) if method == "robust" else F.lit(0.0))
           .otherwise((F.col(c) - mid(c)) / spread(c)) for c in cols}
    return told.withColumns(out).drop(*[f"{c}__{x}" for c in cols for x in ("mid", "spread")])


# ---------------------------------------------------------------- M2 / M3 --

def _assembler(features):
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def random_forest(task: str = "classification", seed: int = 42, **params):
    # statistics of a pass, for each task at work; the node of each row is kept, or every pass would send the trees to every task
    p = {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 2, "maxMemoryInMB": 256, "cacheNodeIds": True, **params}
    cls = RandomForestClassifier if task == "classification" else RandomForestRegressor
    return cls(featuresCol="scaled", labelCol="label", seed=seed, **p)


def boosted_trees(task: str = "classification", seed: int = 42, **params):
    """M3 boosted trees, which stop early on the rows marked ``is_validation``:
    one regressor, or for classes the binary estimator that ``fit_classes`` fits
    for each class."""
    p = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8",
         **params}
    cls = GBTClassifier if task == "classification" else GBTRegressor
    return cls(featuresCol="scaled", labelCol="label", seed=seed, validationIndicatorCol="is_validation", **p)


#: Fits that run at the same time.
WORKERS = 3


def at_once(jobs: list, workers: int = WORKERS) -> list:
    """Results of functions run by a bounded pool of threads, in order."""
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(inheritable_thread_target(lambda f: f()), jobs))


def fit_classes(train: DataFrame, estimator: GBTClassifier, workers: int = WORKERS) -> OneVsRestModel:
    """M3 one boosted model for each class, fitted on its own with the validation
    rows, so that each class stops by itself; joined as one model whose raw scores
    ``predict`` turns into probabilities by a softmax."""
    labels = sorted(r[0] for r in train.select("label").distinct().collect())
    classes = int(labels[-1]) + 1 if labels else 0

    def one(c):
        own = train.withColumn("label", (F.col("label") == c).cast("double"))
        return lambda: estimator.copy().fit(own)

    model = OneVsRestModel(at_once([one(c) for c in range(classes)], workers))
    return model._set(featuresCol=estimator.getFeaturesCol(), labelCol="label", predictionCol="prediction", classifier=estimator)


def fit_estimator(train: DataFrame, estimator):
    return fit_classes(train, estimator) if isinstance(estimator, GBTClassifier) else estimator.fit(train)


def fit_pipeline(train: DataFrame, features, estimator) -> PipelineModel:
    front = Pipeline(stages=[_assembler(features), scaler("standard", "features", "scaled")]).fit(train)
    return PipelineModel([*front.stages, fit_estimator(front.transform(train), estimator)])


def evaluate(model: PipelineModel, df: DataFrame, task: str = "classification") -> dict:
    pred = model.transform(df)
    if task == "classification":
        ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="accuracy")
        return {"accuracy": ev.evaluate(pred)}
    ev = RegressionEvaluator(labelCol="label", predictionCol="prediction")
    pred = pred.select("prediction", "label").persist()     # two numbers a row; the features are made once
    try:
        return {"rmse": ev.setMetricName("rmse").evaluate(pred), "r2": ev.setMetricName("r2").evaluate(pred)}
    finally:
        pred.unpersist()


_DRAWN = 1 << 30


def some_rows(df: DataFrame, rows: int | None, *, key=KEY, ts=TS) -> DataFrame:
    """All rows if ``rows`` is None or there are no more, else about so many, chosen by a hash of
    (key, date).  Only for callers that ask for it: no registered query does."""
    if rows is None:
        return df
    n = df.count()
    draw = F.conv(F.substring(_draw(7, key, ts), 1, 8), 16, 10).cast("bigint") % _DRAWN
    return df if n <= rows else df.where(draw < int(rows / n * _DRAWN))


#: Rows that one task of a fit holds, at most about: a row of 400 features takes some 2 kB once it is binned.
TASK_ROWS = 250_000


def in_tasks(rows: DataFrame, *by, fits: int = 1) -> DataFrame:
    """Written rows in one task a core (its share of the cores for each of ``fits`` fits at once),
    or more if a task would get over some ``TASK_ROWS``.  Each task of a forest sends the
    statistics of all nodes, so many small ones cost more than a few large.  Many written parts are put together as they lie, without a shuffle;
    few are dealt anew and held in memory, for the caller to free; of large tables
    only those in fewer parts than cores."""
    cores = -(-rows.sparkSession.sparkContext.defaultParallelism // fits)
    n = rows.count()
    tasks = cores * max(1, -(-n // (cores * TASK_ROWS)))
    if rows._jdf.rdd().getNumPartitions() >= (4 * tasks if n <= TASK_ROWS else cores):
        return rows.coalesce(tasks)
    return rows.repartition(tasks, *by).persist()


def assembled(table: DataFrame, fit_on, *, key=KEY, ts=TS) -> tuple[DataFrame, list]:
    """The features of ``table`` as one scaled vector (column ``scaled``), written
    once for every fit that follows, with key, date, label and the columns
    ``is_train``, ``block``, ``fold``, ``is_validation`` that it has; and the fitted
    front of the pipeline.  Missing features are 0, as in ``predict`` (a row without a date lacks its parts).  The scaler sees all rows where ``fit_on`` holds.  For the
    rows of a fit: all that is given is written."""
    told = [c for c in ("is_train", "block", "fold", "is_validation") if c in table.columns]
    feats = [c for c in feature_columns(table, key, ts) if c not in told]
    joined = _assembler(feats)
    rows = cut_lineage(joined.transform(table.fillna(0, subset=feats)).select(key, ts, "label", *told, "features"))
    front = scaler("standard", "features", "scaled").fit(rows.where(fit_on))
    return front.transform(rows).drop("features"), [joined, front]


def cross_val_scores(train: DataFrame, make_estimator, folds: int = 5, task: str = "classification",
                     workers: int = WORKERS) -> list[float]:
    """Scores of ``fold`` 0..folds-1 of assembled training rows, fitted on the others; a few at once."""
    def one(k):
        def score():
            model = fit_estimator(train.where(F.col("fold") != k), make_estimator())
            r = evaluate(model, train.where(F.col("fold") == k), task)
            return r["accuracy"] if task == "classification" else -r["rmse"] ** 2
        return score
    return at_once([one(k) for k in range(folds)], workers)


def train(table: DataFrame, model: str = "random_forest", task: str = "classification", test_size: float = 0.2,
          cv_folds: int = 0, fit_rows: int | None = None, *, key=KEY, ts=TS, **params):
    """M2 / M3 temporal split (the table's own ``is_train``, if it has one), scaled
    fit, train / test metrics, optional k-fold CV.  All training rows (about
    ``fit_rows`` of them, if a caller gives it) are assembled, written once and
    fitted on; every test row is made and scored without being written.  Returns
    (PipelineModel, metrics dict, test predictions DataFrame)."""
    split = table if "is_train" in table.columns else temporal_split(table, test_size, key=key, ts=ts)
    split = k_folds(split, 10, key=key, ts=ts).withColumn("is_validation", F.col("fold") == 0)
    if cv_folds:
        split = k_folds(split.drop("fold"), cv_folds, key=key, ts=ts)
    tr, front = assembled(some_rows(split.where("is_train"), fit_rows, key=key, ts=ts), F.lit(True), key=key, ts=ts)
    te = split.where("not is_train").fillna(0, subset=front[0].getInputCols())
    te = PipelineModel(front).transform(te).select(*tr.columns)
    tr = in_tasks(tr, key, ts)     # recomputed from the written rows if lost
    make = (lambda: random_forest(task, **params)) if model == "random_forest" else (lambda: boosted_trees(task, **params))
    try:
        fitted = fit_estimator(tr, make())
        metrics = {f"train_{k}": v for k, v in evaluate(fitted, tr, task).items()}
        metrics.update({f"test_{k}": v for k, v in evaluate(fitted, te, task).items()})
        if cv_folds:
            sc = cross_val_scores(tr, make, cv_folds, task)
            mean = sum(sc) / len(sc)
            metrics.update({"cv_mean": mean, "cv_std": (sum((s - mean) ** 2 for s in sc) / len(sc)) ** 0.5})
    finally:
        tr.unpersist()
    return PipelineModel([*front, fitted]), metrics, fitted.transform(te)


def feature_importance(pm: PipelineModel, features, spark) -> DataFrame:
    """T4 features by importance, descending."""
    est = pm.stages[-1]
    if hasattr(est, "featureImportances"):
        imp = est.featureImportances.toArray().tolist()
    else:   # one-vs-rest: mean of the per-class importances
        arrs = [m.featureImportances.toArray() for m in est.models]
        imp = [float(sum(a[i] for a in arrs) / len(arrs)) for i in range(len(features))]
    rows = list(zip(list(features), [float(v) for v in imp]))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"),
                                                                                  F.asc("feature"))


def rank_importance(importances: DataFrame) -> DataFrame:
    """T4 shares of the total importance and ranks; shares that agree to nine
    decimals are tied, ties go by name.  The table has a row per feature, so its
    window is as small as the list of columns."""
    w = S.Window.partitionBy(F.lit(0))
    total = F.sum("importance").over(w)
    return importances.select("feature", F.try_divide(F.col("importance"), total).alias("importance"),
                              F.row_number().over(w.orderBy(F.desc_nulls_last(S.rnd(F.try_divide(F.col("importance"), total), 9)), "feature")).alias("rank"))


# -------------------------------------------------------------- A23 --

def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """A23 counts per (label, prediction)."""
    return pred.groupBy(F.col(label).cast("int").alias("label"),
                        F.col(prediction).cast("int").alias("prediction")).agg(F.count("*").alias("count"))


def class_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """A23 precision / recall / f1 / support per class: each row counts
    towards its true class and its predicted class (explode of the distinct
    pair, no join), then one aggregate."""
    p = pred.select(F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("p"))
    x = p.select(F.explode(F.array_distinct(F.array("y", "p"))).alias("c"), "y", "p")
    g = x.groupBy("c").agg(F.count_if((F.col("y") == F.col("c")) & (F.col("p") == F.col("c"))).alias("tp"),
                           F.count_if(F.col("p") == F.col("c")).alias("pred_n"),
                           F.count_if(F.col("y") == F.col("c")).alias("support"))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("pred_n")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return g.select(F.col("c").alias("class"), prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), "support")


# ---------------------------------------------------------- M4 --

RF_GRID = {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 15, 30], "minInstancesPerNode": [1, 2, 4]}
GBT_GRID = {"maxIter": [50, 100, 200], "maxDepth": [3, 6, 9], "stepSize": [0.01, 0.1, 0.2],
            "subsamplingRate": [0.8, 0.9, 1.0]}


def tune(table: DataFrame, model: str = "random_forest", task: str = "classification", grid: dict | None = None,
         n_splits: int = 3, fit_rows: int | None = None, workers: int = WORKERS, *, key=KEY, ts=TS):
    """M4 grid search with forward-chaining folds (train on the past, validate on
    the next block); returns (best params, best mean score, all scores: accuracy,
    or minus the squared error).  Spark's ``CrossValidator.foldCol`` would train
    on future blocks, so the folds are explicit.  ``maxDepth`` None of the
    reference maps to 30 (Spark's limit).  A table's own ``block`` is used if it has one.

    A fit with the most trees holds those with fewer (its first trees), and a
    forest's deepest trees hold the shallower ones, so one fit serves all such
    combinations (``SubModels``): 9 fits for the 36 of the forest grid, 81 for
    each class of the boosted one.  Fits and validation run on all rows (about
    ``fit_rows``, if a caller gives it), assembled once, ``workers`` fits at a time.  (A depth is
    exact unless a level outgrows ``maxMemoryInMB``; then the trees are others of the same kind.)"""
    from verdant.operators.submodels import SubModels

    grid = grid or (RF_GRID if model == "random_forest" else GBT_GRID)
    forest = model == "random_forest"
    cut = table if "block" in table.columns else forward_folds(table, n_splits, key=key, ts=ts)
    d = some_rows(cut, fit_rows, key=key, ts=ts)
    rows, _ = assembled(d, F.lit(True), key=key, ts=ts)
    rows = in_tasks(rows, key, ts, fits=workers)
    count, nested = ("numTrees", {"numTrees", "maxDepth"}) if forest else ("maxIter", {"maxIter"})
    others = [k for k in grid if k not in nested]
    make = random_forest if forest else boosted_trees
    groups = [dict(zip(others, x)) for x in product(*[grid[k] for k in others])]
    most = {k: max(grid[k]) for k in nested if k in grid}

    def one(params, i):
        past = rows.where(F.col("block") <= i)
        # boosting has no early stop here: all iterations are wanted
        est = make(task, **params, **most)
        if not forest:
            est.clear(est.validationIndicatorCol)
        depths = grid.get("maxDepth", [None]) if forest else [None]
        return lambda: SubModels(fit_estimator(past, est), rows.where(F.col("block") == i + 1), grid.get(count, [None]), depths, not forest, task).scores()

    try:
        told = at_once([one(p, i) for p in groups for i in range(n_splits)], workers)
    finally:
        rows.unpersist()
    results = []
    for g, params in enumerate(groups):
        folds = told[g * n_splits:(g + 1) * n_splits]
        for n, depth in folds[0]:
            own = {**params, **({count: n} if n is not None else {}), **({"maxDepth": depth} if depth is not None else {})}
            results.append(({k: own[k] for k in grid}, sum(f[n, depth] for f in folds) / n_splits))
    best = max(results, key=lambda t: t[1])
    return best[0], best[1], results


# ---------------------------------------------------------- M5 / S11 --

def predict(pm: PipelineModel, table: DataFrame) -> DataFrame:
    """M5 predictions with class probabilities (missing features -> 0); the
    one-vs-rest model has raw scores only, turned into probabilities by a
    softmax."""
    feats = [c for c in pm.stages[0].getInputCols()]
    t = table.fillna(0, subset=feats)
    out = pm.transform(t)
    if "probability" in out.columns:
        prob = vector_to_array("probability")
    else:
        raw = vector_to_array("rawPrediction")
        ex = F.transform(raw, lambda v: F.exp(v))
        prob = F.transform(ex, lambda v: v / F.aggregate(ex, F.lit(0.0), lambda a, b: a + b))
    return out.withColumn("probabilities", prob).withColumn("confidence", F.array_max("probabilities"))


def save_model(pm: PipelineModel, path: str) -> None:
    """S11 persist a fitted pipeline (scaler + model)."""
    pm.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ---------------------------------------------------------- M6-M8, A22 --

def correlation_pairs(df: DataFrame, cols, threshold: float = 0.95) -> DataFrame:
    """A22 |Pearson r| for every column pair (rows with both values), flagging
    pairs above ``threshold``; from co-moment blocks, one for each task."""
    cols = list(cols)
    names = F.array(*[F.lit(c) for c in cols])
    pairs = pair_correlations(df, cols).where("i < j")
    return pairs.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), F.abs("r").alias("r")).withColumn("high", F.col("r") > threshold)


def anova_f(df: DataFrame, cols, label: str = "label") -> DataFrame:
    """M6 one-way ANOVA F statistic of every feature against the class label
    (scikit-learn's f_classif).  Per class and feature: count, mean and M2 (sum of
    squared deviations), which merge without the cancellation of plain sums of
    squares."""
    long_ = df.select(F.col(label).alias("__y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])).alias("s")).select("__y", "s.*")
    per = long_.groupBy("feature", "__y").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"))
    whole = S.Window.partitionBy("feature")     # a row per feature and class
    per = per.withColumn("grand", F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole))
    g = per.groupBy("feature").agg(F.sum("n").alias("N"), F.count("*").alias("k"), F.sum("m2").alias("within"),
                                   F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("between"))
    f = F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("N") - F.col("k")))
    return g.select("feature", f.alias("f_score"))


def regression_f(df: DataFrame, cols, target: str) -> DataFrame:
    """M6 F statistic of every feature in a one-variable linear regression of a
    numeric target (scikit-learn's f_regression): r^2 / (1 - r^2) x (n - 2)."""
    long_ = df.select(F.col(target).cast("double").alias("__y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])).alias("s")).select("__y", "s.*")
    g = long_.groupBy("feature").agg(F.regr_r2("__y", "x").alias("r2"), F.regr_count("__y", "x").alias("n"))
    return g.select("feature", F.try_divide(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2")).alias("f_score"))


def select_univariate(df: DataFrame, cols, k: int = 50, label: str = "label", task: str = "classification") -> DataFrame:
    """M6 the ``k`` features with the largest F statistic.  Statistics that agree to
    four decimals are tied; ties go by name."""
    scores = anova_f(df, cols, label) if task == "classification" else regression_f(df, cols, label)
    return scores.orderBy(F.desc_nulls_last(S.rnd("f_score", 4)), "feature").limit(min(k, len(cols)))


def select_univariate_ml(df: DataFrame, cols, k: int = 50, label: str = "label"):
    """M6 with Spark's selector (ANOVA F test, categorical label)."""
    sel = UnivariateFeatureSelector(featuresCol="features", outputCol="selected", labelCol=label,
                                    selectionMode="numTopFeatures").setFeatureType("continuous") \
        .setLabelType("categorical").setSelectionThreshold(min(k, len(cols)))
    a = _assembler(cols).transform(df.fillna(0, subset=list(cols)))
    m = sel.fit(a)
    return [cols[i] for i in m.selectedFeatures]


def select_correlation(df: DataFrame, cols, k: int = 50, threshold: float = 0.95, label: str = "label") -> DataFrame:
    """M8 drop every later column of a pair with |r| > threshold, then keep
    the top ``k`` by F statistic if more remain (tied to four decimals: by name).
    Rows ``feature``."""
    scores = anova_f(df, cols, label)
    drop = correlation_pairs(df, cols, threshold).where("high").select(F.col("b").alias("feature")).distinct()
    keep = scores.join(drop, "feature", "left_anti")
    return keep.orderBy(F.desc_nulls_last(S.rnd("f_score", 4)), "feature").limit(k).select("feature")


def select_rfe(df: DataFrame, cols, k: int = 50, label: str = "label", step_trees: int = 50, step: float = 0.0) -> list[str]:
    """M7 recursive elimination: fit a forest on all rows, drop the least important features
    (one, or the share ``step`` of those left; ties: the later one goes), refit,
    until ``k`` remain.  Features are assembled once; a slice of the vector feeds each refit."""
    cols = list(cols)
    rows = in_tasks(cut_lineage(_assembler(cols).transform(df.fillna(0, subset=cols)).select("features", F.col(label).alias("label"))))
    keep = list(range(len(cols)))
    while len(keep) > k:
        cut = VectorSlicer(inputCol="features", outputCol="kept", indices=keep).transform(rows)
        model = RandomForestClassifier(featuresCol="kept", labelCol="label", numTrees=step_trees, seed=42, maxMemoryInMB=512).fit(cut)
        imp = model.featureImportances.toArray()
        gone = sorted(range(len(keep)), key=lambda i: (imp[i], -i))[:min(len(keep) - k, max(1, int(len(keep) * step)))]
        keep = [c for i, c in enumerate(keep) if i not in set(gone)]
    rows.unpersist()
    return [cols[i] for i in keep]
