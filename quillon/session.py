"""Sessions with the settings the engine relies on."""

from __future__ import annotations

import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Session settings; values that a cluster sets itself are left alone.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "quillon", master: str | None = None, **conf: str) -> SparkSession:
    """A session; `conf` takes settings with dots written as double underscores."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, unless PYTHONPATH has it for them; once a context."""
    home = Path(__file__).resolve().parent
    if str(home.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_quillon", False):
        return
    with tempfile.TemporaryDirectory() as d:
        shutil.copytree(home, f"{d}/{home.name}", ignore=shutil.ignore_patterns("__pycache__"))
        kept = f"{tempfile.mkdtemp()}/{home.name}.zip"  # the driver serves it as long as the context lives
        with zipfile.PyZipFile(kept, "w") as z:
            z.writepy(f"{d}/{home.name}")
    spark.sparkContext.addPyFile(kept)
    spark.sparkContext._quillon = True
