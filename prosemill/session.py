"""Sessions: for tests and scripts, and what Python workers need to find this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver did; on a cluster where it is installed this changes nothing."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def scratch(spark: SparkSession) -> str:
    """A new path in the folder for checkpoints: the context's, or what spark.checkpoint.dir names. Without either, a folder of this
    machine in local mode; on a cluster, whose executors must all see it, that is an error."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def local(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session as the tests and the bench use it."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("prosemill")
    fixed = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return ready(b.config(map=fixed | conf).getOrCreate())
