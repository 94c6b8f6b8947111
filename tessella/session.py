"""A session with the settings the engine expects; a caller's own session works as well."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(app: str = "tessella", master: str = "local[*]", **conf: str) -> SparkSession:
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
    }
    return SparkSession.builder.appName(app).master(master).config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine, where it is unset, any folder."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tessella-shared-")
        sc.setCheckpointDir(at)
    return at if "://" in at or at.startswith("file:") else f"file://{at}"


def ship(spark: SparkSession) -> None:
    """Send a zip of this package to executors, unless they find it by PYTHONPATH or the working folder."""
    sc = spark.sparkContext
    if _ROOT in os.environ.get("PYTHONPATH", "").split(":") or os.getcwd() == _ROOT or getattr(sc, "_tessella_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), "tessella_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(os.path.join(_ROOT, "tessella")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, _ROOT))
    sc.addPyFile(path)
    sc._tessella_shipped = True
