"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES``
a comma list of other queries than the default ones.
"""

from __future__ import annotations

import json
import os
import time

from cellzonal.session import local_session
from workload.queries import QUERIES

HEADLINE = (
    "hex_carbon_country",
    "hex_richness_country",
    "zonal_richness_children",
    "zonal_richness_occupancy",
    "zonal_richness_species",
    "hex_richness",
    "species_table",
    "zonal_carbon",
    "range_hex_richness_fine",
    "range_zonal_richness",
    "aoi_cells_fine",
    "stored_zonal_carbon",
    "hex_carbon_country_l8",
    "hex_richness_country_l8",
    "zonal_richness_children_l8",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)  # compiles the generated code and fills the file listings
        seconds[name] = round(min(run(name) for _ in range(runs)), 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
                "cores": cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
