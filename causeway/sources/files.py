"""Reading and writing of samples, event logs and graphs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, header: bool = True, index: str | None = None, schema: str | None = None) -> DataFrame:
    """Samples from CSV (also under the name .npz or .txt, as numbers separated by commas), Parquet, ORC or JSON.

    index: a column that only numbers the rows, left out of the result.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "npz", "txt"):
        header = header and kind == "csv"
        reader = spark.read.option("header", header)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    elif kind in ("parquet", "orc", "json"):
        df = getattr(spark.read.schema(schema) if schema else spark.read, kind)(path)
    else:
        raise ValueError(f"no reader for .{kind}")
    return df.drop(index) if index else df


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header, numbers without one under .npz or .txt, or Parquet, ORC, JSON, by the path's ending."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "npz", "txt"):
        df.write.mode(mode).option("header", kind == "csv").csv(path)
    elif kind in ("parquet", "orc", "json"):
        getattr(df.write.mode(mode), kind)(path)
    else:
        raise ValueError(f"no writer for .{kind}")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An event log: event string, timestamp double, node int; other columns are left out."""
    df = read_table(spark, path)
    if missing := {"event", "timestamp", "node"} - set(df.columns):
        raise ValueError(f"the event log lacks {sorted(missing)}")
    return df.select(F.col("event").cast("string").alias("event"), F.col("timestamp").cast("double").alias("timestamp"), F.col("node").cast("int").alias("node"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Entries (src, dst, weight) other than 0 of binary array files (.npy) with two dimensions."""
    import io

    import numpy as np
    import pyarrow as pa

    def entries(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                a = np.load(io.BytesIO(content), allow_pickle=False)
                i, j = np.nonzero(a)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(a[i, j].astype(float))], ["src", "dst", "weight"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(entries, "src int, dst int, weight double")


def labelled_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, labels, content) of images whose file names are their labels, joined by underscores."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    stem = F.regexp_extract("path", r"([^/]+)\.[A-Za-z]+$", 1)
    labels = F.transform(F.regexp_extract_all(stem, F.lit(r"-?\d+(?:\.\d+)?"), 0), lambda x: x.cast("double"))
    return files.select("path", labels.alias("labels"), "content")


def edge_list(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target) as strings; a node without edges is its own row with target '-'."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    lone = nodes.select(F.col(nodes.columns[0]).alias("node")).join(ends, "node", "left_anti")
    return edges.select(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target")).union(lone.select(F.col("node").cast("string"), F.lit("-")))


def edge_list_json(edges: DataFrame, nodes: DataFrame) -> str:
    """The edge list as one JSON array of pairs; a graph is small by then."""
    return json.dumps(sorted([r["source"], r["target"]] for r in edge_list(edges, nodes).collect()))


def submission_row(edges: DataFrame, d: int) -> DataFrame:
    """One row: the d x d 0/1 matrix, row by row, joined by spaces. Nodes are 0 .. d - 1."""
    place = F.col("src") * d + F.col("dst")
    ones = edges.filter("src >= 0 and dst >= 0").filter((F.col("src") < d) & (F.col("dst") < d)).agg(F.collect_set(place.cast("int")).alias("ones"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(d * d - 1)), lambda k: F.when(F.array_contains("ones", k), "1").otherwise("0"))
    return ones.select(F.concat_ws(" ", cells).alias("row"))


def checksum(spark: SparkSession, path: str, md5: str | None = None) -> bool:
    """Whether the files exist and, if md5 is given, have that digest (all contents in the order of their paths)."""
    rows = spark.read.format("binaryFile").load(path).orderBy("path").select("content").toLocalIterator()
    found = hashlib.md5()
    for r in rows:
        found.update(r["content"])
    return md5 is None or found.hexdigest() == md5


class Registry:
    """Named datasets: builders that take a session and give (data, true edges, topology edges or None)."""

    def __init__(self) -> None:
        self._builders: dict[str, Callable] = {}

    def register(self, name: str, builder: Callable) -> None:
        self._builders[name] = builder

    def names(self) -> list[str]:
        return sorted(self._builders)

    def load(self, spark: SparkSession, name: str, **options) -> tuple:
        if name not in self._builders:
            raise ValueError(f"unknown dataset {name!r}; there are {', '.join(self.names())}")
        return self._builders[name](spark, **options)


datasets = Registry()


def alarm_archive(spark: SparkSession, folder: str) -> tuple:
    """An alarm data set in a folder: Alarm.csv, DAG.npy and, where there is one, Topology.npy."""
    events = read_table(spark, f"{folder}/Alarm.csv")
    truth = read_matrix(spark, f"{folder}/DAG.npy").select("src", "dst")
    try:
        topology = read_matrix(spark, f"{folder}/Topology.npy").select("src", "dst")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        topology = None
    return events, truth, topology


#: Names of the published alarm data sets, their folders, and the digests of their archives.
ALARM_SETS = {
    "V18_N55_Wireless": ("18V_55N_Wireless", "36ee135b86c8dbe09668d9284c23575b"),
    "V24_N439_Microwave": ("24V_439N_Microwave", "b4c8b32d34c04a86aa93c7259f7d086c"),
    "V25_N474_Microwave": ("25V_474N_Microwave", "51f43ed622d4b44ef6daf8fabf81e162"),
}


def alarm_set(folder: str, md5: str) -> Callable:
    def build(spark: SparkSession, root: str, check: bool = False) -> tuple:
        """The unpacked folder under root; with check, the archive beside it must have the published digest."""
        if check and not checksum(spark, f"{root}/{folder}.tar.gz", md5):
            raise ValueError(f"{root}/{folder}.tar.gz is not the published archive")
        return alarm_archive(spark, f"{root}/{folder}")

    return build


datasets.register("alarm_archive", alarm_archive)
for _name, (_folder, _md5) in ALARM_SETS.items():
    datasets.register(_name, alarm_set(_folder, _md5))
