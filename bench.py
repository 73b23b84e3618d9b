"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from latticework.plans import registry

HEADLINE = ("part_graph_strong", "laplacian", "galerkin", "smooth_filter", "norm_laplacian", "spmm", "feature_graph", "graph_fusion", "conductance", "clustering_coefficient", "node2vec_transition", "connected_components", "nodal_energy", "param_summary", "best_config", "speedup_vs_baseline", "spectral_filter", "refinement", "reweight_edges", "spmm_dense", "hierarchy_complexity")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    with tempfile.TemporaryDirectory() as shared:
        conf = {"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{shared}", "spark.ui.showConsoleProgress": "false"}
        spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
        spark.range(1000).selectExpr("sum(id)").collect()
        took = {}
        for name in HEADLINE:
            began = time.time()
            registry.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
        spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
