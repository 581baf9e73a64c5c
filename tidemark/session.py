"""Sessions with the settings that the engine's results rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "tidemark", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, use the one that spark-submit configures.

    UTC and adaptive execution are what the operators expect; everything else is sizing.
    """
    n = cpus or os.cpu_count() or 4
    settings = {
        "spark.master": f"local[{n}]",
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()
