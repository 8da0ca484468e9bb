"""``python -m snaptable [FOLDER] [PORT]``: serves a database until ``quit`` is read."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from snaptable import fixed
from snaptable.database import Database
from snaptable.sources.server import SqlServer


def main(args: list[str]) -> None:
    folder, port = args[0] if args else fixed.FOLDER, int(args[1]) if len(args) > 1 else fixed.PORT
    spark = SparkSession.builder.appName("snaptable").config("spark.scheduler.mode", "FAIR").getOrCreate()
    with Database(spark, folder) as db:
        server = SqlServer(db, port).start()
        print(f"listening on port {server.port}; '{fixed.QUIT}' ends", flush=True)
        for line in sys.stdin:
            if line.strip() == fixed.QUIT:
                break
        server.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
