"""Headline queries of the search engine at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gramlake import catalog
from gramlake.operators.index import TrigramIndex


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    path = tempfile.mkdtemp(prefix="bench-") + "/index"
    took = {}

    def timed(name, f, times=1):
        """The median of several runs."""
        runs = []
        for _ in range(times):
            start = time.time()
            f()
            runs.append(time.time() - start)
        took[name] = round(statistics.median(runs), 3)

    timed("index_build", lambda: catalog.index(spark, sf_dir).write(path))
    ix = TrigramIndex.open(spark, path)
    run = lambda df: df.agg(F.count("*")).collect()
    run(ix.search("License"))  # warm
    for name, pattern, options in (("literal", "Apache License", {}), ("and", r"tion .*the\b", {}), ("or", "heiten|eaux", {}), ("ignore_case", "license", {"ignore_case": True}), ("all_fallback", "[.]$", {}), ("rare", "worthless", {})):
        timed(f"search_{name}", lambda p=pattern, o=options: run(ix.search(p, **o)), 3)
        timed(f"brute_{name}", lambda p=pattern, o=options: run(ix.search(p, brute=True, **o)), 3)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
