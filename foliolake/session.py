"""Sessions whose Python workers can import this package and keep little memory."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: What Python workers are started with: one heap, and Arrow memory given back.
WORKER_ENV = {"MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "1048576", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Rows and bytes of a batch for a Python worker; texts are long, so the defaults would hold hundreds of MB.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def importable(spark: SparkSession) -> SparkSession:
    """Adds the folder that holds the package to the workers' path; on executors where it isn't, nothing changes."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    for k, v in WORKER_ENV.items():
        env.setdefault(k, v)
    for k, most in BATCHES.items():
        try:
            now = int(spark.conf.get(k).rstrip('b'))
        except Exception:
            continue
        if now <= 0 or now > most:
            spark.conf.set(k, str(most))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, only where that is unset, the checkpoint folder in use or in local mode one of our own."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not have.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foliolake-"))
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
    return have.get().rstrip("/")
