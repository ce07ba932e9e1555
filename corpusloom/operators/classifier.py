"""A classifier of code by its syntax: fitted, saved with its vocabulary, loaded again, and tuned with all trials in one pass."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import syntax as S
from ..sources.scans import scan_source_files
from ..sources.sinks import work_path, write_parquet
from . import ranks as R

#: Iterations after which trials are compared, and what part of them goes on.
RUNGS, ETA = (2, 6, 18), 3


def feature_stages(min_df: float = 1.0, shapes: int = 1 << 12) -> list:
    """Weighed counts of node types, and hashed counts of whole subtrees."""
    return [
        CountVectorizer(inputCol="nodes", outputCol="counts", minDF=min_df), IDF(inputCol="counts", outputCol="weighed"),
        HashingTF(inputCol="subtrees", outputCol="shapes", numFeatures=shapes), VectorAssembler(inputCols=["weighed", "shapes"], outputCol="features"),
    ]


def classifier(reg: float = 0.01, elastic: float = 0.0, iterations: int = 20) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=reg, elasticNetParam=elastic, maxIter=iterations)


def with_subtrees(rows: DataFrame, ids: dict[str, int]) -> DataFrame:
    """rows with nodes and subtrees, each of these as the text of its encoding; rows have code."""
    trees = F.transform("trees", lambda t: F.array_join(t.cast("array<string>"), " "))
    encoded = rows.withColumn("m", S.metrics_in_place("code")).where("m.valid").withColumn("trees", S.subtree_encoder(ids)("code"))
    return encoded.withColumn("nodes", F.col("m.nodes")).withColumn("subtrees", trees).drop("code", "m", "trees")


def fitted(rows: DataFrame) -> PipelineModel:
    """A model of encoded rows, see ``with_subtrees``, with label and weight."""
    return Pipeline(stages=[*feature_stages(), classifier()]).fit(rows)


# A saved model


def python() -> str:
    return ".".join(map(str, sys.version_info[:2]))


def save(model: PipelineModel, ids: dict[str, int], path: str) -> None:
    """Write a model, the vocabulary that its subtrees are encoded by, and the Python whose parser made them."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame(sorted(ids.items()), "node_type string, node_id int").coalesce(1).write.mode("overwrite").parquet(f"{path}/vocabulary")  # the node types of Python
    spark.createDataFrame([(python(),)], "python string").coalesce(1).write.mode("overwrite").json(f"{path}/parser")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict[str, int]]:
    """A saved model and its vocabulary; an error under another Python, which may parse to other trees."""
    made = spark.read.schema("python string").json(f"{path}/parser").first().python
    if made != python():
        raise ValueError(f"the model was made with Python {made}, this is {python()}")
    ids = {r.node_type: r.node_id for r in spark.read.parquet(f"{path}/vocabulary").collect()}  # the node types of Python
    return PipelineModel.load(f"{path}/model"), ids


def scored(model: PipelineModel, ids: dict[str, int], files: DataFrame, key: str) -> DataFrame:
    """Blocks of every file, each with its class and both probabilities; files have code."""
    blocks = files.select(key, F.posexplode(S.normalised_blocks("code")).alias("block", "b"))
    rows = with_subtrees(blocks.select(key, "block", "b.code", F.lit(1.0).alias("weight")), ids)
    chance = vector_to_array("probability")
    return model.transform(rows).select(key, "block", F.col("prediction").cast("int").alias("class"), chance[0].alias("p_ai"), chance[1].alias("p_human"))


def score_folder(spark: SparkSession, model_path: str, folder: str, suffix: str = ".py") -> DataFrame:
    """The blocks of all source files below a folder by a saved model."""
    model, ids = load(spark, model_path)
    return scored(model, ids, scan_source_files(spark, folder, suffix), "full_path")


# Trials in one pass


class Trials:
    """Logistic models of one table under several settings, advanced together by accelerated proximal steps.

    A step sends all weights, a number for each feature and living trial, and reads the table once; each task multiplies
    its rows with all of them and returns sums of gradients.  The step length is that of rows of length one."""

    def __init__(self, rows: DataFrame, size: int, space: list[dict]):
        """rows: as of ``sparse``, of length one at most, with label and weight; a space's settings: reg and elastic."""
        self.rows, self.size, self.space = rows, size + 1, space
        self.total = float(rows.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]) or 1.0
        self.weights = {t: np.zeros(self.size) for t in range(len(space))}  # the last is the intercept
        self.before = {t: (np.zeros(self.size), 1.0) for t in self.weights}
        self.done = dict.fromkeys(self.weights, 0)

    def advance(self, trials: list[int], iterations: int) -> None:
        """Bring these trials to so many iterations, from where they are."""
        while behind := [t for t in trials if self.done[t] < iterations]:
            gradients = self.gradients(np.stack([self.before[t][0] for t in behind]))
            for t, gradient in zip(behind, gradients):
                self.step(t, gradient)

    def step(self, t: int, gradient: np.ndarray) -> None:
        length, reg, elastic = 2.0, self.space[t]["reg"], self.space[t]["elastic"]  # 4 over the square of a row with its intercept
        ahead, momentum = self.before[t]
        moved = ahead - length * gradient
        plain = moved[:-1]
        plain = np.sign(plain) * np.maximum(np.abs(plain) - length * reg * elastic, 0) / (1 + length * reg * (1 - elastic))
        new = np.append(plain, moved[-1])
        faster = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        self.before[t] = (new + (momentum - 1) / faster * (new - self.weights[t]), faster)
        self.weights[t] = new
        self.done[t] += 1

    def gradients(self, weights: np.ndarray) -> np.ndarray:
        """The gradient of the mean loss at each row of weights."""
        held, size = self.rows.sparkSession.sparkContext.broadcast(weights), self.size

        def summed(batches):
            total = np.zeros((size, len(held.value)))
            for part in batches:
                rows, (owner, at, x) = range(len(part)), laid(part, size - 1)
                margins = np.zeros((len(rows), len(held.value)))
                np.add.at(margins, owner, held.value.T[at] * x[:, None])
                error = (1 / (1 + np.exp(-np.clip(margins, -500, 500))) - part["label"].to_numpy()[:, None]) * part["weight"].to_numpy()[:, None]
                np.add.at(total, at, error[owner] * x[:, None])
            yield pd.DataFrame({"trial": range(total.shape[1]), "sums": list(total.T)})

        def together(parts: pa.Table) -> pa.Table:
            sums = np.sum([x for x in parts.column("sums").combine_chunks().flatten().to_numpy().reshape(parts.num_rows, size)], axis=0)
            return pa.table({"trial": parts.column("trial")[:1], "sums": pa.array([sums], pa.list_(pa.float64()))})

        found = self.rows.mapInPandas(summed, "trial int, sums array<double>").groupBy("trial").applyInArrow(together, "trial int, sums array<double>")
        return np.stack([r.sums for r in found.orderBy("trial").collect()]) / self.total  # a row for each living trial

    def predictions(self, rows: DataFrame, trials: list[int]) -> DataFrame:
        """trial, label and pred of every row under each of the trials."""
        held, size = rows.sparkSession.sparkContext.broadcast(np.stack([self.weights[t] for t in trials])), self.size

        def told(batches):
            for part in batches:
                owner, at, x = laid(part, size - 1)
                margins = np.zeros((len(part), len(trials)))
                np.add.at(margins, owner, held.value.T[at] * x[:, None])
                yield pd.DataFrame({"trial": np.tile(trials, len(part)), "label": np.repeat(part["label"].to_numpy(np.int64), len(trials)), "pred": (margins > 0).astype(np.int64).ravel()})

        return rows.mapInPandas(told, "trial long, label long, pred long")


def laid(part: pd.DataFrame, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of all numbers of some rows, with a one for the intercept at the last place."""
    sizes = part["at"].map(len).to_numpy()
    owner = np.concatenate([np.repeat(np.arange(len(part)), sizes), np.arange(len(part))])
    at = np.concatenate([*part["at"], np.full(len(part), last)]).astype(np.int64)
    return owner, at, np.concatenate([*part["x"], np.ones(len(part))])


def sparse(rows: DataFrame, features: str, *others: str) -> DataFrame:
    """The places and values, at and x, of the numbers of a vector column that are not zero, beside other columns."""

    def cut(batches):
        for part in batches:
            dense = part.pop("_dense")
            part["at"] = [np.flatnonzero(x) for x in dense]
            part["x"] = [x[i] for x, i in zip(dense, part["at"])]
            yield part

    told = rows.select(*others, vector_to_array(features).alias("_dense"))
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)
    return told.mapInPandas(cut, f"{fields}, at array<long>, x array<double>")


def f1_by_trial(predictions: DataFrame) -> dict[int, float]:
    """F1 of each trial, mean over the true classes weighed by their rows; predictions: trial, label and pred."""
    cells = predictions.groupBy("trial", "label", "pred").agg(F.count("*").alias("n")).collect()  # four for each trial
    out = {}
    for t in {c.trial for c in cells}:
        n = {(c.label, c.pred): c.n for c in cells if c.trial == t}
        total, score = sum(n.values()), 0.0
        for x in {a for a, _ in n}:
            right, told, true = n.get((x, x), 0), sum(v for (_, b), v in n.items() if b == x), sum(v for (a, _), v in n.items() if a == x)
            score += true / total * (2 * right / (told + true))
        out[t] = score
    return out


def tuned(rows: DataFrame, held, space: list[dict], rungs: tuple[int, ...] = RUNGS, eta: int = ETA) -> DataFrame:
    """trial, its setting, iterations and F1 on held-out rows; after each rung the best part of the trials goes on from
    where it is.  A rung costs a pass for each iteration and one for the scores, however many trials live."""
    spark = rows.sparkSession
    features = Pipeline(stages=[*feature_stages(), Normalizer(inputCol="features", outputCol="unit")]).fit(rows.where(~held))
    coded = features.transform(rows.withColumn("label", F.col("label").cast("long")).withColumn("weight", F.col("weight").cast("double")).withColumn("held", held))
    ready = write_parquet(sparse(coded, "unit", "label", "weight", "held"), work_path(spark, "features"))
    size = len(features.stages[0].vocabulary) + features.stages[2].getNumFeatures()
    trials, alive, log = Trials(ready.where("NOT held"), size, space), list(range(len(space))), []
    schema = "bracket int, iterations int, trial int, reg_param double, elastic_net double, f1 double"
    for rung in rungs:
        trials.advance(alive, rung)
        scores = f1_by_trial(trials.predictions(ready.where("held"), alive))
        log += [(0, rung, t, space[t]["reg"], space[t]["elastic"], scores.get(t, 0.0)) for t in alive]
        table = spark.createDataFrame(log, schema)  # a row for each trial and rung
        alive = [r.trial for r in R.rung_promotions(table, "bracket", "iterations", "trial", "f1", [rung], eta).orderBy("trial").collect()]
    return table.drop("bracket")
