"""Session defaults and the few session-level helpers every operator shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lipika", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans were written for; `conf` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder the cluster names in spark.checkpoint.dir.

    Only in local mode, where driver and executor are one machine, may the setting be absent; on a cluster that raises."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "lipika-checkpoints"))
    return df.checkpoint()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package where their path lacks it (once per session)."""
    root = Path(__file__).resolve().parent
    if any(Path(p or ".").resolve() == root.parent for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p):
        return
    context = spark.sparkContext
    if getattr(context, "_lipika_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="lipika-")  # the driver serves the archive from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/lipika", "zip", root.parent, root.name))
    context._lipika_shipped = True
