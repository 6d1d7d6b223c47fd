"""Fitted models as tables: a version is written once and read by any later job, without a refit.

Below ``<folder>/version=N`` lie ``nodes`` (a row for each node of a tree), ``centres`` (a row for each
centre) and ``parameters`` (one row). All are bounded by the models' own parameters.
"""

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlight.operators.forest import Forest
from ledgerlight.operators.ml import FEATURES, AnomalyModel, ClusterModel, PriorityModel, Scaler

FORMAT = 1
NODES = ("tree int, node int, feature int, split double, left int, right int, length double, "
         "expected double")
CENTRES = "cluster int, centre array<double>"
PARAMETERS = ("format int, features array<string>, cut double, mean array<double>, "
              "deviation array<double>")


def _place(folder: str, version: int, name: str) -> str:
    return f"{folder}/version={version}/{name}"


def save_model(spark: SparkSession, model: PriorityModel, folder: str, version: int) -> None:
    """Write one version; a version that exists is an error, never overwritten.

    ``parameters`` is written last, and a version without it is not complete.
    """
    forest, clusters = model.anomalies.forest, model.clusters
    nodes = [
        (tree, node, int(forest.feature[tree][node]), float(forest.split[tree][node]),
         int(forest.left[tree][node]), int(forest.right[tree][node]),
         float(forest.length[tree][node]), float(forest.expected[tree]))
        for tree in range(len(forest.feature)) for node in range(len(forest.feature[tree]))
    ]
    centres = [(k, [float(x) for x in centre]) for k, centre in enumerate(clusters.centres)]
    parameters = [(FORMAT, list(FEATURES), float(model.anomalies.cut),
                   [float(x) for x in clusters.scaler.mean],
                   [float(x) for x in clusters.scaler.deviation])]
    for name, rows, schema in (("nodes", nodes, NODES), ("centres", centres, CENTRES),
                               ("parameters", parameters, PARAMETERS)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(_place(folder, version, name))


def model_nodes(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(NODES).parquet(_place(folder, version, "nodes"))


def load_model(spark: SparkSession, folder: str, version: int) -> PriorityModel:
    """The model of a version, equal to the one that was written to the last bit."""
    parameters = spark.read.schema(PARAMETERS).parquet(_place(folder, version, "parameters")).first()
    if parameters is None or parameters.format != FORMAT or parameters.features != FEATURES:
        raise ValueError(f"version {version} in {folder} was written for other features or formats")
    rows = model_nodes(spark, folder, version).orderBy("tree", "node").collect()
    trees = rows[-1].tree + 1

    def packed(name, kind):
        return np.array([r[name] for r in rows], dtype=kind).reshape(trees, -1)

    forest = Forest(packed("feature", np.int32), packed("split", float), packed("left", np.int32),
                    packed("right", np.int32), packed("length", float), packed("expected", float)[:, 0])
    centres = spark.read.schema(CENTRES).parquet(_place(folder, version, "centres"))
    return PriorityModel(
        AnomalyModel(forest, parameters.cut),
        ClusterModel(Scaler(parameters.mean, parameters.deviation),
                     [list(r.centre) for r in centres.orderBy(F.col("cluster")).collect()]))
