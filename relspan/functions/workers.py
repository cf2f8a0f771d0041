"""Makes this package importable where Python workers run."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def one_machine(spark: SparkSession) -> bool:
    """Whether driver and workers are one process's, so that they share folders."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def importable(spark: SparkSession) -> SparkSession:
    """Workers of a local session look where this package is; to a cluster's it is sent, once an application."""
    sc = spark.sparkContext
    if one_machine(spark):
        paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
        if _ROOT not in paths:
            sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, *paths]))
    elif sc.applicationId not in _sent:
        folder = tempfile.mkdtemp()  # the driver serves the file from there as long as it runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        package = os.path.join(folder, f"relspan-{uuid.uuid4().hex}.zip")
        with zipfile.ZipFile(package, "w") as z:
            for at, _, names in os.walk(os.path.join(_ROOT, "relspan")):
                for name in names:
                    if name.endswith(".py"):
                        z.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), _ROOT))
        sc.addPyFile(package)
        _sent.add(sc.applicationId)
    return spark
