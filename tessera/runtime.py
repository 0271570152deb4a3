"""Making this package known to Python workers, wherever they run."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
import zipfile

#: Settings, their defaults, and what is set instead where the default holds: whole texts
#: make rows long, so fewer go to a Python worker at a time.
SMALLER = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),)

_shipped: set[str] = set()


def ship(spark) -> None:
    """Send the package's modules to the executors, once an application.

    Workers import functions by name; neither a working folder nor a search
    path of the driver's needs to exist on their machines.
    """
    for key, usual, ours in SMALLER:
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, ours)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-package-"), "tessera_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for here, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(here, n)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_path(spark) -> str:
    """A new path under spark.checkpoint.dir; a folder of this machine only where that is unset and the master local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        root = "file://" + local
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def settled(df):
    """``df`` written to a new shared path and read again."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shipped(f):
    """``f(spark, ...)`` with the package sent first."""

    @functools.wraps(f)
    def run(spark, *args, **kwargs):
        ship(spark)
        return f(spark, *args, **kwargs)

    return run
