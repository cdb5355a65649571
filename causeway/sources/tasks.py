"""Tasks from a configuration: simulate data or learn a graph, score it, and keep a log of the runs."""

from __future__ import annotations

import ast
import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators.metrics import graph_metrics
from causeway.plans import base
from causeway.sources import files, simulate

LOG = "task_id string, name string, algorithm string, parameters string, dataset string, started double, ended double, status string, edges string, metrics string"
METRICS = ("fdr", "tpr", "fpr", "shd", "nnz", "precision", "recall", "f1", "gscore")


def coerce(text):
    """The value that a text stands for: None, a truth value, a number, a tuple or list of such, or a product of
    numbers such as 2*3; anything else stays as it is."""
    if not isinstance(text, str):
        return text
    words = {"none": None, "null": None, "true": True, "false": False}
    if text.strip().lower() in words:
        return words[text.strip().lower()]
    try:
        return ast.literal_eval(text.strip())
    except (ValueError, SyntaxError):
        factors = [coerce(part) for part in text.split("*")] if "*" in text else []
        return math.prod(factors) if factors and all(isinstance(f, (int, float)) for f in factors) else text


def learn_task(spark: SparkSession, config: dict, log: str | None = None) -> tuple[base.Graph, dict]:
    """config: dataset (path, or name of a registered one), columns, algorithm, parameters, and optionally
    truth (path of an .npy matrix), metrics (names), output (path for the edges). Returns the graph and its metrics."""
    from causeway.plans import constraint, continuous, deep, hawkes, lingam, neural, pairwise, score  # noqa: F401  (they register learners)

    task, began, status, edges, found = uuid.uuid4().hex, time.time(), "failed", "", {}
    try:
        if config["dataset"] in files.datasets.names():
            data, truth, _ = files.datasets.load(spark, config["dataset"], **config.get("dataset_options", {}))
        else:
            data, truth = files.read_table(spark, config["dataset"]), None
        if config.get("truth"):
            truth = files.read_matrix(spark, config["truth"])
        columns = config.get("columns") or [c for c in data.columns if c != "row"]
        graph = base.make(config["algorithm"], **{k: coerce(v) for k, v in config.get("parameters", {}).items()}).learn(data, columns)
        table = graph.edges(spark)
        edges = json.dumps(sorted([r["src_name"], r["dst_name"]] for r in table.collect()))
        if truth is not None:
            row = graph_metrics(table.select("src", "dst"), truth.select("src", "dst"), len(columns)).first().asDict()
            found = {k: row[k] for k in config.get("metrics", METRICS)}
        if config.get("output"):
            files.write_table(table, config["output"])
        status = "done"
        return graph, found
    finally:
        if log:
            row = (task, config.get("name", task), config.get("algorithm"), json.dumps(config.get("parameters", {})), config.get("dataset"), began, time.time(), status, edges, json.dumps(found))
            spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(log)


def simulate_task(spark: SparkSession, config: dict) -> DataFrame:
    """config: kind, nodes, edges, rows, and optionally method, sem, scale, seed, output. Returns the rows."""
    w = simulate.random_dag(config["kind"], config["nodes"], config["edges"], config.get("seed", 0))
    rows = simulate.sample(spark, w, config["rows"], config.get("method", "linear"), config.get("sem", "gauss"), config.get("scale", 1.0), config.get("seed", 0))
    if config.get("output"):
        files.write_table(rows, config["output"])
    return rows


def runs(spark: SparkSession, log: str) -> DataFrame:
    """The log of runs, latest first."""
    return spark.read.schema(LOG).parquet(log).orderBy(F.desc("ended"))


def run_file(spark: SparkSession, path: str):
    """A configuration in YAML or JSON with task: simulate or learn."""
    import yaml

    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    config = yaml.safe_load(text)
    if config.get("task") not in ("simulate", "learn"):
        raise ValueError("task must be simulate or learn")
    return simulate_task(spark, config) if config["task"] == "simulate" else learn_task(spark, config, config.get("log"))
