"""Session defaults and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "tollgate", **conf: str) -> SparkSession:
    """A session with the settings the library is tested with; the cluster's own settings win where given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # The JVM does not compile methods above 8000 bytes; wide projections run faster split up than fused and interpreted.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_run: ContextVar[str | None] = ContextVar("run", default=None)


@cache
def _local_folder() -> str:
    """One folder of this machine for this process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="tollgate-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for cut points, below the shared folder the cluster names in ``spark.checkpoint.dir``, or below the
    folder of the run that :func:`run_folder` has opened.

    Only a local session without that setting may use this machine's temporary folder: on a cluster the executors
    would each write to their own disk and a lost machine would take its part of the table with it.
    """
    shared = _run.get() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _local_folder()
    return f"{shared}/{name}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """Put the cut points of everything inside into one folder, and remove it at the end: write results within."""
    path = work_folder(spark, name)
    token = _run.set(path)
    try:
        yield path
    finally:
        _run.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
