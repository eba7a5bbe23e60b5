"""Standardized logistic model over feature columns, its metrics and walk-forward evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.longseries import materialize, with_index
from ..functions import scalars as S


def fit_standardizer(d: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample standard deviation per column (one aggregate row); a constant column gets 1."""
    row = d.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] if (row[f"s_{c}"] or 0.0) > 1e-9 else 1.0) for c in cols}


def standardize(d: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return d.select(*[c for c in d.columns if c not in scale], *[((F.col(c) - m) / s).alias(c) for c, (m, s) in scale.items()])


def fit(d: DataFrame, cols: list[str], label: str = "label", l2: float = 1.0, iterations: int = 100):
    """Balanced class weights, L2 of ``l2 / n``, standardized inputs; returns (scale, fitted model)."""
    scale = fit_standardizer(d, cols)
    n = d.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p")).first()
    pos, total = float(n["p"] or 0), float(n["n"])
    w = F.when(F.col(label) == 1, total / (2.0 * max(pos, 1.0))).otherwise(total / (2.0 * max(total - pos, 1.0)))
    x = VectorAssembler(inputCols=cols, outputCol="features").transform(standardize(d, scale).withColumn("weight", w).withColumn(label, F.col(label).cast("double")))
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=l2 / max(total, 1.0), elasticNetParam=0.0, standardization=False, maxIter=iterations)
    return scale, lr.fit(x.select("features", label, "weight"))


def predict(d: DataFrame, cols: list[str], scale, model, out: str = "p") -> DataFrame:
    z = d.select("*", *[((F.col(c) - scale[c][0]) / scale[c][1]).alias(f"_z_{c}") for c in cols])
    x = VectorAssembler(inputCols=[f"_z_{c}" for c in cols], outputCol="_v").transform(z)
    r = model.transform(x.withColumnRenamed("_v", "features"))
    return r.withColumn(out, vector_to_array("probability")[1]).select(*d.columns, out)


def top_factors(spark, cols: list[str], model, k: int) -> DataFrame:
    rows = [(c, float(w)) for c, w in zip(cols, model.coefficients.toArray())]
    return spark.createDataFrame(rows, "feature string, weight double").orderBy(F.abs("weight").desc(), "feature").limit(k)


def contributions(d: DataFrame, cols: list[str], scale, model, k: int) -> DataFrame:
    """The ``k`` largest |weight x z| of every row."""
    parts = F.array(*[F.struct((-F.abs((F.col(c) - scale[c][0]) / scale[c][1] * float(w))).alias("o"), F.lit(c).alias("feature"),
                               ((F.col(c) - scale[c][0]) / scale[c][1] * float(w)).alias("contribution")) for c, w in zip(cols, model.coefficients.toArray())])
    return d.withColumn("factors", F.slice(F.array_sort(parts), 1, k))


def log_loss(p="p", y="label"):
    q = F.least(F.greatest(F.col(p), F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.avg(F.when(F.col(y) == 1, -F.log(q)).otherwise(-F.log(1 - q)))


def auc(d: DataFrame, keys: list[str] = [], p: str = "p", y: str = "label") -> DataFrame:
    """Rank AUC with tied scores averaged; NULL when one class is missing.

    Counts per distinct score come first, so ranks are running sums over scores, and scores are cut into
    slices of [0, 1] so that no single task holds them all."""
    c = d.groupBy(*keys, p).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos")).withColumn("_b", F.floor(F.col(p) * 256))
    w = Window.partitionBy(*keys, "_b").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    b = c.groupBy(*keys, "_b").agg(F.sum("n").alias("_n"))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    b = b.select(*keys, "_b", F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_off"))
    c = c.withColumn("_r", F.coalesce(F.sum("n").over(w), F.lit(0))).join(b, [*keys, "_b"])
    rank = F.col("_off") + F.col("_r") + (F.col("n") + 1) / 2.0
    g = c.groupBy(*keys).agg(F.sum(rank * F.col("pos")).alias("_s"), F.sum("pos").cast("double").alias("_p"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("_q"))
    return g.select(*keys, F.when((F.col("_p") > 0) & (F.col("_q") > 0), F.try_divide(F.col("_s") - F.col("_p") * (F.col("_p") + 1) / 2, F.col("_p") * F.col("_q"))).alias("auc"))


def calibration(d: DataFrame, bins: int = 10, p: str = "p", y: str = "label") -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    g = d.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("actual"))
    return d.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(g, "bin", "left").na.fill(0, ["n"])


def evaluate(d: DataFrame, keys: list[str] = [], p: str = "p", y: str = "label", threshold: float = 0.5) -> DataFrame:
    n, pos = F.count(F.lit(1)), F.sum(y)
    g = d.groupBy(*keys).agg(n.alias("n"), log_loss(p, y).alias("log_loss"), F.avg((((F.col(p) >= threshold).cast("int")) == F.col(y)).cast("double")).alias("accuracy"), (F.greatest(pos, n - pos) / n).alias("baseline"))
    a = auc(d, keys, p, y)
    return g.join(a, keys) if keys else g.crossJoin(a)


# -- one fit for every key ------------------------------------------------------------------------

def _moments(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Count, positives, and the mean and scale of each input, one row per key."""
    x = rows.select(*keys, "_y", F.posexplode("_x").alias("_j", "_v"))
    g = x.groupBy(*keys, "_j").agg(F.avg("_v").alias("m"), F.stddev_samp("_v").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"))
    scale = F.when(F.col("s") > 1e-9, F.col("s")).otherwise(1.0)
    g = g.groupBy(*keys).agg(F.max("n").alias("n"), F.max("pos").cast("double").alias("positives"), F.array_sort(F.collect_list(F.struct("_j", F.coalesce("m", F.lit(0.0)).alias("m"), scale.alias("s")))).alias("_m"))
    return g.select(*keys, "n", "positives", F.col("_m.m").alias("mean"), F.col("_m.s").alias("scale"))


def keyed_fit(d: DataFrame, keys: list[str], cols: list[str], label: str = "label", l2: float = 1.0, iterations: int = 25, tol: float = 1e-10) -> DataFrame:
    """The model of :func:`fit` for every key at once: ``keys, n, positives, mean, scale, weights`` (the first is the intercept)
    and ``gradient``, the largest slope left at the optimum.

    Newton steps: every round sums the slopes and products of all keys in one aggregation, first within batches, and solves one
    small system a key.  The driver sees one number a round, the longest step."""
    size = len(cols) + 1
    rows = materialize(d.select(*keys, F.array(*[F.col(c).cast("double") for c in cols]).alias("_x"), F.col(label).cast("double").alias("_y")), "fit-rows")
    moments = materialize(_moments(rows, keys, size), "fit-moments")
    kinds = ", ".join(f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keys)
    corner = np.triu_indices(size)

    def sums(batches):
        for b in batches:
            for key, g in b.groupby(keys, dropna=False, sort=False):
                z = (np.stack(g["_x"].to_numpy()) - g["mean"].iloc[0]) / g["scale"].iloc[0]
                z, y = np.column_stack([np.ones(len(z)), z]), g["_y"].to_numpy()
                n, pos = float(g["n"].iloc[0]), float(g["positives"].iloc[0])
                weight = np.where(y == 1, n / (2 * max(pos, 1.0)), n / (2 * max(n - pos, 1.0)))
                p = 1 / (1 + np.exp(-np.clip(z @ g["weights"].iloc[0], -700, 700)))
                products = (z * (weight * p * (1 - p))[:, None]).T @ z
                yield pd.DataFrame({**dict(zip(keys, key)), "parts": [np.concatenate([z.T @ (weight * (p - y)), products[corner]])]})

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        v, w = g.sort_values("_j")["v"].to_numpy(), np.asarray(g["weights"].iloc[0])
        penalty = np.append(0.0, np.full(size - 1, l2))
        slope, products = v[:size] + penalty * w, np.zeros((size, size))
        products[corner] = v[size:]
        products = products + np.triu(products, 1).T + np.diag(penalty)
        step = np.linalg.lstsq(products, slope, rcond=None)[0]
        return pd.DataFrame({**{k: [g[k].iloc[0]] for k in keys}, "weights": [w - step], "step": [float(np.abs(step).max())], "gradient": [float(np.abs(slope).max())]})

    found = moments.withColumn("weights", F.array_repeat(F.lit(0.0), size))
    for _ in range(iterations):
        parts = rows.join(found.select(*keys, "n", "positives", "mean", "scale", "weights"), keys).mapInPandas(sums, f"{kinds}, parts array<double>")
        parts = parts.select(*keys, F.posexplode("parts").alias("_j", "_v")).groupBy(*keys, "_j").agg(F.sum("_v").alias("v"))
        stepped = parts.join(found.select(*keys, "weights"), keys).groupBy(*keys).applyInPandas(solve, f"{kinds}, weights array<double>, step double, gradient double")
        found = materialize(moments.join(stepped, keys), "fit-weights")
        if (found.agg(F.max("step")).first()[0] or 0.0) < tol:
            break
    return found.drop("step")


def keyed_predict(d: DataFrame, keys: list[str], cols: list[str], models: DataFrame, out: str = "p") -> DataFrame:
    z = d.withColumn("_x", F.array(*[F.col(c).cast("double") for c in cols])).join(models.select(*keys, "mean", "scale", "weights"), keys)
    scaled = F.zip_with(F.zip_with("_x", "mean", lambda x, m: x - m), "scale", lambda x, s: x / s)
    score = F.get("weights", F.lit(0)) + F.aggregate(F.zip_with(scaled, F.slice("weights", 2, len(cols)), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return z.withColumn(out, S.sigmoid(score)).select(*d.columns, out)


def fold_table(d: DataFrame, order: str, folds: int = 4, keys: list[str] = [], tie: list[str] = []) -> DataFrame:
    """Adds ``fold`` (0 to ``folds``): equal runs of each key's rows in ``order``, equal times by ``tie``."""
    by = keys or ["_one"]
    x = d if keys else d.withColumn("_one", F.lit(1))
    x = with_index(x, by, [order, *tie], F.floor(S.ms(order) / 86_400_000), "_i")
    n = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    x = x.join(n, by).withColumn("fold", F.least(F.floor(F.col("_i") * (folds + 1) / F.col("_n")), F.lit(folds)).cast("int"))
    return x.drop("_i", "_n", *([] if keys else ["_one"]))


def fold_report(x: DataFrame, label: str = "label", folds: int = 4, min_rows: int = 10, keys: list[str] = []) -> DataFrame:
    """(keys, fold, train_rows, train_positives, test_rows, skipped): running sums over the folds tell which of them cannot be
    fitted or are too short to be scored."""
    c = x.groupBy(*keys, "fold").agg(F.count(F.lit(1)).alias("test_rows"), F.sum(label).alias("_p"))
    w = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("train_rows", F.coalesce(F.sum("test_rows").over(w), F.lit(0))).withColumn("train_positives", F.coalesce(F.sum("_p").over(w), F.lit(0)))
    one_class = (F.col("train_positives") == 0) | (F.col("train_positives") == F.col("train_rows"))
    return c.filter(F.col("fold") > 0).select(*keys, "fold", "train_rows", "train_positives", "test_rows", ((F.col("test_rows") < min_rows) | one_class).alias("skipped"))


def walk_forward(d: DataFrame, cols: list[str], order: str, folds: int = 4, label: str = "label", l2: float = 1.0, min_rows: int = 10, keys: list[str] = [], tie: list[str] = []) -> DataFrame:
    """Expanding-window folds of every key: fold f is scored by a model of all earlier rows of its key.  All (key, fold) models are
    fitted at once.  Folds that cannot be are left out here and named by :func:`fold_report`; if none can be, no row is."""
    x = materialize(fold_table(d, order, folds, keys, tie), "folds")
    able = fold_report(x, label, folds, min_rows, keys).filter(~F.col("skipped")).select(*keys, "fold")
    train = x.withColumnRenamed("fold", "_f").withColumn("fold", F.explode(F.expr(f"filter(sequence(1, {folds}), f -> f > _f)"))).join(F.broadcast(able) if not keys else able, [*keys, "fold"])  # without keys: one row a fold
    models = keyed_fit(train, [*keys, "fold"], cols, label, l2)
    return keyed_predict(x, [*keys, "fold"], cols, models)
