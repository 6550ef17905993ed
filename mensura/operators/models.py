"""Models on pyspark.ml, the resumable model grid, and association statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array, array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import confound_level, direction_arrow, nan_to_null, partial_verdict
from ..session import broadcast_if_small, cut_lineage
from .expect import enforce, predictions_complete
from .joins import job_plan, without
from .metrics import partial_spearman, regression_metrics, spearman
from .ordering import cumulative, with_hash_slots

SEED = 42


def forest_regressor(trees: int = 500, depth: int = 10, features: str = "features", label: str = "y", seed: int = SEED) -> Estimator:
    return RandomForestRegressor(
        numTrees=trees, maxDepth=depth, featuresCol=features, labelCol=label, seed=seed,
        featureSubsetStrategy="all", predictionCol="y_pred",
    )


def boosted_regressor(rounds: int = 500, depth: int = 6, step: float = 0.05, features: str = "features", label: str = "y",
                      seed: int = SEED, subsample: float = 1.0) -> Estimator:
    return GBTRegressor(
        maxIter=rounds, maxDepth=depth, stepSize=step, featuresCol=features, labelCol=label, seed=seed,
        subsamplingRate=subsample, predictionCol="y_pred", checkpointInterval=10,
    )


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight n / (classes · n_class): every class counts the same. The class table is sent to all only if counted small."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    facts = counts.agg(F.sum("__c").alias("__n"), F.count(F.lit(1)).alias("__k")).first()
    per = counts.select(label, (F.lit(float(facts["__n"] or 0)) / (F.lit(facts["__k"]) * F.col("__c"))).alias(out))
    return df.join(broadcast_if_small(per), label)


def forest_classifier(trees: int = 500, depth: int = 10, features: str = "features", label: str = "y", weight: str | None = "weight", seed: int = SEED) -> Estimator:
    extra = {"weightCol": weight} if weight else {}
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, featuresCol=features, labelCol=label, seed=seed, **extra
    )


def boosted_classifier(rounds: int = 500, depth: int = 6, step: float = 0.05, features: str = "features", label: str = "y", seed: int = SEED) -> Estimator:
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, featuresCol=features, labelCol=label, seed=seed)


def margin_classifier(iterations: int = 100, regularisation: float = 1 / 8, features: str = "features", label: str = "y") -> Estimator:
    return LinearSVC(maxIter=iterations, regParam=regularisation, featuresCol=features, labelCol=label)


def network_classifier(layers: Sequence[int], iterations: int = 100, features: str = "features", label: str = "y", seed: int = SEED) -> Estimator:
    return MultilayerPerceptronClassifier(layers=list(layers), maxIter=iterations, featuresCol=features, labelCol=label, seed=seed)


def with_label(df: DataFrame, label: str) -> DataFrame:
    """The rows that a model can learn from and be judged by: those whose label is a number."""
    return df.where(nan_to_null(label).isNotNull())


def fit_score(estimator: Estimator, train: DataFrame, test: DataFrame) -> DataFrame:
    return estimator.fit(train).transform(test)


def class_scores(scored: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``label_pred`` and a real-valued ``score`` of the positive class."""
    source = "probability" if "probability" in scored.columns else "rawPrediction"
    return scored.select(
        *keep, F.col("prediction").cast("int").alias("label_pred"), vector_to_array(source)[1].alias("score")
    )


def mean_baseline(rows: DataFrame, fold: str, y: str) -> DataFrame:
    """Prediction = mean of the training rows, for all folds at once.

    Train sums are the overall sums minus the fold's own, so one small aggregate serves every fold.
    """
    per = rows.groupBy(fold).agg(F.sum(y).alias("__s"), F.count(y).alias("__c"))
    total = per.agg(F.sum("__s").alias("s"), F.sum("__c").alias("c")).first()
    means = per.select(
        fold, F.try_divide(F.lit(float(total["s"] or 0)) - F.col("__s"), F.lit(total["c"] or 0) - F.col("__c")).alias("y_pred")
    )
    return rows.join(broadcast_if_small(means), fold)


def pending_jobs(plan: DataFrame, done: DataFrame, keys: Sequence[str] = ("representation", "algorithm", "partition")) -> DataFrame:
    """Jobs of the plan without a finished result."""
    return without(plan, done.select(*keys).distinct(), keys)


JOB = ["representation", "algorithm", "partition"]


def finished_rows(plan: DataFrame, done: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """Rows of those jobs of the plan that have one usable prediction for every row of their partition."""
    rows = done.select(key, "partition", "fold", "representation", "algorithm", *[F.col(c).cast("double").alias(c) for c in ("y_true", "y_pred")])
    usable = F.when(F.col("y_pred").isNotNull() & ~F.isnan("y_pred"), F.col(key))
    have = rows.groupBy(*JOB).agg(F.countDistinct(usable).alias("__have"), F.count(F.lit(1)).alias("__rows"))
    want = folds.groupBy("partition").agg(F.count(F.lit(1)).alias("__want"))
    whole = have.join(want, "partition").where("__have = __want AND __rows = __want")
    # One row per job on the right: small by construction.
    return rows.join(plan.select(*JOB).distinct().join(whole, JOB, "left_semi"), JOB, "left_semi").select(*rows.columns)


def model_grid(
    data: DataFrame,
    folds: DataFrame,
    key: str,
    y: str,
    representations: Mapping[str, str],
    algorithms: Mapping[str, Callable[[str], Estimator]],
    done: DataFrame | None = None,
    parallel: int = 4,
    sink: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Out-of-fold predictions of every representation × algorithm × partition × fold, plus
    the mean baseline.

    ``representations`` maps a name to its vector column, ``algorithms`` a name to a factory
    taking that column. The driver only submits jobs; features and predictions stay on the
    executors. Finished (representation, algorithm, partition) jobs in ``done`` are not trained
    again: their rows come back with the new ones, so the table is whole however often a run
    was stopped. A job that lacks predictions is not finished and is trained anew. ``sink``
    receives each newly finished batch. Rows without ``y`` train no model but are predicted.
    """
    spark = data.sparkSession
    shape = folds.agg(F.max("partition").alias("p"), F.max("fold").alias("k")).first()
    n_partitions, n_folds = int(shape["p"]) + 1, int(shape["k"]) + 1
    plan = job_plan(spark, list(representations), list(algorithms), n_partitions, n_folds)
    kept = None
    if done is not None:
        kept = finished_rows(plan, done, folds, key)
        plan = pending_jobs(plan, kept)
    # The plan has one row per model to train: small by construction.
    jobs = sorted({(r["representation"], r["algorithm"], r["partition"]) for r in plan.collect()})
    table = data.select(key, F.col(y).cast("double").alias("y_true"), F.col(y).cast("double").alias("y"), *representations.values())
    table = table.withColumn("y", nan_to_null("y"))
    joined = cut_lineage(folds.select(key, "partition", "fold").join(table, key))

    def columns(df: DataFrame, rep: str, alg: str) -> DataFrame:
        return df.select(
            key, "partition", "fold", F.lit(rep).alias("representation"), F.lit(alg).alias("algorithm"),
            "y_true", F.col("y_pred").cast("double").alias("y_pred"),
        )

    def run(job: tuple[str, str, int]) -> DataFrame:
        rep, alg, part = job
        rows = joined.where(F.col("partition") == part)
        if rep not in representations:
            out = columns(mean_baseline(rows.drop(*representations.values()), "fold", "y"), rep, alg)
        else:
            vector, out = representations[rep], None
            for fold in range(n_folds):
                model = algorithms[alg](vector).fit(with_label(rows.where(F.col("fold") != fold), "y"))
                scored = columns(model.transform(rows.where(F.col("fold") == fold)), rep, alg)
                out = scored if out is None else out.unionByName(scored)
        out = cut_lineage(out)
        enforce(predictions_complete(out, rows.select(key), key, "y_pred"))
        if sink is not None:
            sink(out)
        return out

    with ThreadPool(max(1, min(parallel, len(jobs) or 1))) as pool:
        batches = pool.map(run, jobs)
    if kept is not None:
        batches = [kept, *batches]
    oof = batches[0]
    for batch in batches[1:]:
        oof = oof.unionByName(batch)
    return oof


def impurity_importance(
    data: DataFrame, folds: DataFrame, key: str, names: Sequence[str], estimator: Callable[[str], Estimator],
    features: str = "features", fitted: dict[int, Model] | None = None,
) -> DataFrame:
    """Mean and population sd of a tree model's importances over folds; ``fitted`` receives the model of each fold.

    Rows without label train no model.
    """
    rows = cut_lineage(folds.where(F.col("partition") == 0).select(key, "fold").join(data, key))
    n_folds = int(rows.agg(F.max("fold")).first()[0]) + 1

    def one(fold: int) -> list[tuple[str, int, float]]:
        learner = estimator(features)
        model = learner.fit(with_label(rows.where(F.col("fold") != fold), learner.getLabelCol()))
        if fitted is not None:
            fitted[fold] = model
        return [(n, fold, float(v)) for n, v in zip(names, model.featureImportances.toArray())]

    with ThreadPool(min(4, n_folds)) as pool:
        found = [item for part in pool.map(one, range(n_folds)) for item in part]
    table = data.sparkSession.createDataFrame(found, "feature string, fold int, importance double")
    return table.groupBy("feature").agg(
        F.avg("importance").alias("importance_mean"), F.stddev_pop("importance").alias("importance_sd")
    )


def ranked_importance(impurity: DataFrame, permutation: DataFrame, associations: DataFrame) -> DataFrame:
    """One row per feature: impurity and permutation importance with their ranks, signed correlation and direction.

    A feature that one table lacks keeps its row with NULL there. Few rows: one per feature.
    """
    def part(df: DataFrame, name: str) -> DataFrame:
        rank = F.rank().over(Window.partitionBy().orderBy(F.col("importance_mean").desc_nulls_last()))
        return df.select(
            "feature", F.col("importance_mean").alias(f"{name}_mean"), F.col("importance_sd").alias(f"{name}_sd"), rank.alias(f"{name}_rank")
        )

    both = part(impurity, "impurity").join(part(permutation, "permutation"), "feature", "full_outer")
    return both.join(associations.select("feature", "rho", "direction"), "feature", "full_outer").orderBy(
        F.col("permutation_rank").asc_nulls_last(), "feature"
    )


def permuted_copies(test: DataFrame, key: str, values: str, size: int, repeats: int, seed: int = SEED) -> DataFrame:
    """Test rows with one array position shuffled, for every position and repeat.

    The shuffle pairs two independent seeded orders of the same rows by position: row at
    position *i* receives the value of the row that is *i*-th in the other order.
    """
    base = test.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))

    def positions(salt: int) -> DataFrame:
        hashed = base.select("repeat", key, F.xxhash64(key, "repeat", F.lit(seed + salt)).alias("__hash")).withColumn("__one", F.lit(1))
        run = cumulative(with_hash_slots(hashed, "__hash"), ["repeat"], ["__hash", key], ["__one"])
        return run.select("repeat", key, F.col("__one_before").alias("__pos"))

    taker = base.join(positions(0), ["repeat", key])
    giver = base.select("repeat", key, F.col(values).alias("__given")).join(positions(1), ["repeat", key]).drop(key)
    paired = taker.join(giver, ["repeat", "__pos"])
    each = paired.withColumn("feature_index", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    mixed = F.transform(
        F.col(values), lambda x, i: F.when(i == F.col("feature_index"), F.get(F.col("__given"), i)).otherwise(x)
    )
    return each.withColumn(values, mixed).drop("__given", "__pos")


def permutation_importance(
    data: DataFrame, folds: DataFrame, key: str, y: str, values: str, names: Sequence[str],
    estimator: Callable[[str], Estimator], repeats: int = 10, seed: int = SEED, fitted: Mapping[int, Model] | None = None,
) -> DataFrame:
    """Loss of R² on the held-out fold when one feature is shuffled; mean and sd over folds.

    ``values`` is an array column. All features and repeats of a fold are scored in one job. ``fitted`` may hold the
    models of these folds, fitted to the same values in a column ``features``; a fold without one is fitted here.
    Rows without ``y`` take no part: no loss can be told from them.
    """
    vector = "features"
    usable = with_label(data.select(key, F.col(y).cast("double").alias("y"), values), "y")
    rows = cut_lineage(folds.where(F.col("partition") == 0).select(key, "fold").join(usable, key))
    n_folds = int(rows.agg(F.max("fold")).first()[0]) + 1

    def one(fold: int) -> DataFrame:
        def vec(df: DataFrame) -> DataFrame:
            return df.withColumn(vector, array_to_vector(F.col(values)))

        model = (fitted or {}).get(fold) or estimator(vector).fit(vec(rows.where(F.col("fold") != fold)))
        test = rows.where(F.col("fold") == fold)
        base = regression_metrics(model.transform(vec(test)), [], "y", "y_pred").select(F.col("r2")).first()["r2"]
        shuffled = model.transform(vec(permuted_copies(test, key, values, len(names), repeats, seed + fold)))
        each = regression_metrics(shuffled, ["feature_index", "repeat"], "y", "y_pred")
        loss = each.groupBy("feature_index").agg(F.avg(F.lit(base) - F.col("r2")).alias("loss"))
        return cut_lineage(loss.withColumn("fold", F.lit(fold)))

    with ThreadPool(min(4, n_folds)) as pool:
        parts = pool.map(one, range(n_folds))
    losses = parts[0]
    for part in parts[1:]:
        losses = losses.unionByName(part)
    named = F.get(F.array(*[F.lit(n) for n in names]), F.col("feature_index"))
    return losses.groupBy(named.alias("feature")).agg(
        F.avg("loss").alias("importance_mean"), F.stddev_pop("loss").alias("importance_sd")
    )


def feature_associations(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """Signed rank correlation of every feature with y, strongest first, with its direction."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    long = df.select(F.col(y).cast("double").alias("y"), F.inline(cells))
    return spearman(long, ["feature"], "x", "y").withColumn("direction", direction_arrow(F.col("rho")))


def partial_table(df: DataFrame, features: Sequence[str], y: str, z: str) -> DataFrame:
    """Raw and partial rank correlation per feature, and whether the signal survives z."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    long = df.select(F.col(y).cast("double").alias("y"), F.col(z).cast("double").alias("z"), F.inline(cells))
    out = partial_spearman(long, ["feature"], "x", "y", "z")
    return out.withColumn("verdict", partial_verdict(F.col("rho_xy"), F.col("partial")))


def confound_screen(df: DataFrame, features: Sequence[str], y: str, z: str) -> DataFrame:
    """Does a feature follow z more than it should? ρ(x, z), ρ(x, y) and the level."""
    out = partial_table(df, features, y, z)
    return out.select("feature", "n", "rho_xz", "rho_xy", confound_level(F.col("rho_xz")).alias("level"))


