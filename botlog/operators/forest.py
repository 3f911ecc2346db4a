"""Supervised detector: random forest on the per-IP features with the
user-agent flag as the label, trained on the executors: by Spark ML up to
``SPARK_ML_ROWS`` rows, beyond by :mod:`botlog.operators.trees`.

* stratified split: inside each class, rows are ordered by the leading 52
  bits of ``md5(ip:seed)`` and the first round(test_fraction * n_class) go to
  the test set. The per-class cut is an exact order statistic found with
  the bucketed prefix sums (no single-partition window), so the split is
  exact, reproducible and independent of partitioning.
* balanced class weights: n_train / (2 * n_train_class), as a weight column.
* 100 trees, sqrt feature subsets, bootstrap, fixed seed; class counts, split
  thresholds and trees come from all training rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botlog.operators import trees
from botlog.operators.ranking import order_statistics_by
from botlog.session import checkpoint_root


#: Training rows up to which Spark ML grows the forest. Its work is a full set
#: of bin counts for each node and partition, whatever the node's rows.
SPARK_ML_ROWS = 2_000


def hash52(id_col: str, seed: int):
    """Leading 52 bits of ``md5(id:seed)`` as a number that any engine can compute."""
    return F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 13), 16, 10).cast("long")


def stratified_split(df: DataFrame, label: str = "ua_bot_flag", id_col: str = "ip",
                     test_fraction: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds ``is_test`` (int): inside each class, the round(test_fraction *
    n_class) rows with the smallest ``hash52(id, seed)``. The per-class
    cut hashes come from one grouped order-statistics pass."""
    x = df.withColumn("_h", hash52(id_col, seed))

    def ranks(_cls, n):
        k = int(round(test_fraction * n))
        return [k - 1] if k > 0 else []

    kth = order_statistics_by(x, label, "_h", ranks)
    cond = F.lit(False)
    for cls, vals in kth.items():
        if vals and vals[0] is not None:
            cond = cond | ((F.col(label) == F.lit(cls)) & (F.col("_h") <= F.lit(vals[0])))
    return x.withColumn("is_test", cond.cast("int")).drop("_h")


def threshold_split(df: DataFrame, label: str = "ua_bot_flag", id_col: str = "ip",
                    test_fraction: float | dict = 0.3, seed: int = 42) -> DataFrame:
    """Adds ``is_test`` (int) by a threshold on ``hash52(id, seed)`` alone:
    no count, no order statistics and no shuffle, so a row's side is known
    where it is read and never changes as the table grows. ``test_fraction`` is
    one share or a share by class (classes not named: 0). Each class gets its
    share up to chance: of n rows, the number of test rows is binomial."""
    def cut(share: float):
        return F.lit(int(share * 2 ** 52)).cast("long")

    below = cut(0.0)
    if isinstance(test_fraction, dict):
        for cls, share in test_fraction.items():
            below = F.when(F.col(label).eqNullSafe(F.lit(cls)), cut(share)).otherwise(below)
    else:
        below = cut(test_fraction)
    return df.withColumn("is_test", F.coalesce(hash52(id_col, seed) < below, F.lit(False)).cast("int"))


def class_counts(train: DataFrame, label: str = "ua_bot_flag") -> dict:
    """Rows by class."""
    return {r[0]: r[1] for r in train.groupBy(label).count().collect()}


def balanced_weights(counts: dict) -> dict:
    """n / (classes * n of the class) from rows by class."""
    total = sum(counts.values())
    return {cls: total / (len(counts) * n) for cls, n in counts.items()}


@dataclass
class ForestFit:
    model: RandomForestClassificationModel | trees.Forest
    features: list[str]
    label: str

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``bot_probability`` (P(label = 1)) and ``predicted_bot``."""
        if isinstance(self.model, trees.Forest):
            return (self.model.scored(df.fillna(0, subset=self.features), self.features)
                    .withColumns({"bot_probability": F.col("_s.p"), "predicted_bot": F.col("_s.y")}).drop("_s"))
        v = VectorAssembler(inputCols=self.features, outputCol="_x", handleInvalid="keep").transform(
            df.fillna(0, subset=self.features))
        out = self.model.transform(v)
        return (out.withColumn("bot_probability", vector_to_array(F.col("probability"))[1])
                .withColumn("predicted_bot", F.col("prediction").cast("int"))
                .drop("_x", "rawPrediction", "probability", "prediction"))

    def importances(self, spark) -> DataFrame:
        imp = (self.model.importance if isinstance(self.model, trees.Forest) else self.model.featureImportances.toArray()).tolist()
        rows = [(f, float(v)) for f, v in zip(self.features, imp)]
        return spark.createDataFrame(rows, "feature string, importance double")


def fit_random_forest(train: DataFrame, features, label: str = "ua_bot_flag", n_trees: int = 100,
                      seed: int = 42, max_depth: int = 30, max_bins: int = 128, id_col: str = "ip",
                      max_fit_rows: int | None = None, spark_ml_rows: int = SPARK_ML_ROWS) -> ForestFit:
    """Train with balanced class weights on all rows of ``train``. Beyond
    ``spark_ml_rows`` rows with labels 0 and 1 the trees are grown by
    :mod:`botlog.operators.trees`, where rows of one id are drawn together;
    other labels, more bins or more features too where Spark ML would take its
    thresholds from a sample. ``max_fit_rows`` bounds the rows of a node that one
    task fits by itself (None: by the size of the table); the trees do not
    depend on it."""
    features = list(features)
    checkpoint_root(train.sparkSession)
    counts = class_counts(train, label)  # guard and weights from one pass
    if not counts.get(1):
        raise ValueError(f"no positive {label} in the training data: cannot train a supervised model")
    most = min(spark_ml_rows, max_fit_rows or spark_ml_rows)
    if not (set(counts) <= {0, 1} and max_bins <= 256 and len(features) < 128):
        most = max(max_bins ** 2, 10_000)  # rows up to which Spark ML reads all of them for the thresholds
    if sum(counts.values()) > most and all(c is not None and 0 <= c < 1_000 and c == int(c) for c in counts):
        return ForestFit(_fit_trees(train, features, label, counts, n_trees, seed, max_depth, max_bins, id_col, max_fit_rows), features, label)
    wcol = F.lit(0.0)
    for cls, val in balanced_weights(counts).items():
        wcol = F.when(F.col(label) == cls, F.lit(val)).otherwise(wcol)
    data = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(
        train.fillna(0, subset=features)).select("_x", F.col(label).cast("double").alias("_y"), wcol.alias("_w"))
    rf = RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=n_trees, seed=seed,
                                featureSubsetStrategy="sqrt", maxDepth=max_depth, maxBins=max_bins,
                                bootstrap=True, impurity="gini",
                                # node ids cached (and checkpointed every 10 levels) instead of
                                # shipping the growing trees each level; bigger node groups per pass
                                cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=1024)
    return ForestFit(rf.fit(data), features, label)


def _fit_trees(train: DataFrame, features, label: str, counts: dict, n_trees: int, seed: int, max_depth: int, max_bins: int,
               id_col: str, local_rows: int | None) -> trees.Forest:
    weights = balanced_weights(counts)
    plan = trees.Plan(n_trees, seed, max_depth, max_bins, len(features), math.ceil(math.sqrt(len(features))),
                      np.array([weights.get(c, 0.0) for c in range(int(max(weights)) + 1)]))
    rows = train.fillna(0, subset=features)
    of_row = F.xxhash64(*features)
    key = F.when(F.col(id_col).isNull(), of_row).otherwise(F.xxhash64(id_col)) if id_col in train.columns else of_row
    data = rows.select(key.alias("_k"), F.array(*[F.col(f).cast("double") for f in features]).alias("_x"),
                       F.col(label).cast("int").alias("_y"))
    return trees.fit(data, plan, sum(counts.values()), local_rows)


def top_importances(importances: DataFrame, n: int = 5) -> DataFrame:
    return importances.orderBy(F.col("importance").desc(), F.col("feature")).limit(n)
