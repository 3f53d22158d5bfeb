"""SparkSession for local work; on a cluster the session comes from outside."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(cpus: int | str = "*", shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lucidtext")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    settings.setdefault("spark_checkpoint_dir", f"file://{tempfile.mkdtemp(prefix='lucidtext-')}")  # on one machine
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
