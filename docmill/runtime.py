"""Session helpers shared by operators: table loading, lineage cuts, worker import path."""

from __future__ import annotations

import atexit
import logging
import os
import time
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package (on a cluster the repository lies on a shared path)
    and make sure that a checkpoint folder is set; a folder the cluster names is never replaced."""
    sc = spark.sparkContext
    have = sc.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or f"file:///tmp/docmill-checkpoint/{uuid.uuid4().hex}")  # of one machine: for tests only
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. docmill.spread deals the rows of a small file of one row group to so many tasks."""
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = spark.conf.get("docmill.spread", None)
    return t.repartition(int(spread)) if spread else t


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, in which lineage is cut."""
    return prepare(spark).sparkContext.getCheckpointDir()


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once for each row, however often they are used later: the optimiser copies
    a projection into each of its uses, but not a generator."""
    struct = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(struct)))


_tables: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a table written to the shared folder; survives the loss of executors, and is smaller
    than a checkpoint. Tables are removed by release(), else when the process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that cut() wrote, once all that was made of them is itself cut or collected."""
    for t in tables:
        path = getattr(t, "_cut_path", None)
        if path is not None:
            _tables[:] = [x for x in _tables if x[1] != path]
            _remove(t.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _tables:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


def retried(f, times: int = 3, wait: float = 0.0, errors: tuple[type[Exception], ...] = (Exception,), on_failure=None):
    """f, called again after these errors up to so many times in all, waiting twice as long each time; on_failure is
    called once when all have failed. For the driver's own calls; tasks are repeated by Spark."""

    def call(*args, **kwargs):
        for n in range(1, times + 1):
            try:
                return f(*args, **kwargs)
            except errors as e:
                if n == times:
                    if on_failure is not None:
                        on_failure(e)
                    raise
                time.sleep(wait * 2 ** (n - 1))

    return call


def logger(name: str = "docmill", level: int = logging.INFO, path: str | None = None) -> logging.Logger:
    """A logger that writes to the console and, if given, to a file; set up once however often it is asked for."""
    log = logging.getLogger(name)
    log.setLevel(level)
    have = {getattr(h, "baseFilename", "console") for h in log.handlers}
    for h in ([logging.StreamHandler()] if "console" not in have else []) + ([logging.FileHandler(path, encoding="utf-8")] if path and os.path.abspath(path) not in have else []):
        h.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        log.addHandler(h)
    return log
