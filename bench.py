"""Prints one JSON line with the seconds of the headline queries, each the second of two runs."""

import json
import os
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = (
    "masked_weighted_mean", "scalar_derivatives", "vector_derivatives", "elasticity", "stencil_derivative", "inverse_distance", "kernel_integral", "local_integral", "fractional_differences", "delayed_value", "voxel_cloud",
    "norms", "cosine_lines", "discrete_losses", "mechanical_losses", "dense_network", "mesh_distance", "nearest_inverse_distance", "shape_distances")


def main() -> None:
    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '4')}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from axisfield import catalog

    seconds = {}
    for name in HEADLINE:
        for _ in range(2):  # the first run compiles and warms
            began = time.time()
            catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
