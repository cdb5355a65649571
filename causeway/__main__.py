"""python -m causeway CONFIG: run a task from a YAML or JSON file (see sources/tasks.py)."""

from __future__ import annotations

import argparse


def main() -> None:
    parser = argparse.ArgumentParser(prog="causeway", description="Simulate data or learn a causal graph.")
    parser.add_argument("config", help="path of the configuration")
    path = parser.parse_args().config
    from pyspark.sql import SparkSession

    from causeway.sources.tasks import run_file

    spark = SparkSession.builder.appName("causeway").getOrCreate()
    out = run_file(spark, path)
    if isinstance(out, tuple):
        graph, metrics = out
        graph.edges(spark).orderBy("src", "dst").show(200, truncate=False)
        print(metrics)
    else:
        out.show(5)


if __name__ == "__main__":
    main()
