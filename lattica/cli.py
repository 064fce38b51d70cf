"""python -m lattica.cli FOLDER COMMAND [ARGUMENT ...]: ask, node, health, invalidate, lineage, asof, decision, export, query."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from lattica import catalogue
from lattica.api import Mesh


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("lattica").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    folder, command, *rest = args
    mesh = Mesh(spark, folder)
    calls = {"ask": mesh.ask, "node": mesh.get_node, "health": mesh.health, "invalidate": mesh.blast_radius, "lineage": mesh.lineage, "asof": mesh.explain_as_of, "decision": mesh.reconstruct_decision, "export": mesh.export}
    if command == "query":
        catalogue.QUERIES[rest[0]](spark, folder).show(50, truncate=80)
        return 0
    if command not in calls:
        print(__doc__)
        return 2
    out = calls[command](*rest)
    print(out if isinstance(out, str) else json.dumps(out, indent=1, default=str))
    return int(isinstance(out, dict) and "error" in out)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
