"""Session defaults. A cluster's own settings win: only what is unset is set here."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks.

    On a cluster, build the session with its own submit settings and pass it to the operators; none of them needs
    more than ``spark.checkpoint.dir`` and this package on the workers' path.
    """
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.warehouse.dir", tempfile.gettempdir() + "/millrace-warehouse")
    )
    if "PYSPARK_PYTHON" not in os.environ:
        import sys

        os.environ["PYSPARK_PYTHON"] = sys.executable
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share. It is set to a local one only where the session names none, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-ckpt-"))
    return named or sc._jsc.sc().getCheckpointDir().get()
