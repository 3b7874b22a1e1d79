"""Tables written between jobs, in the folder all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Only where it is unset and
the master is local (tests, a laptop) a folder of this process is used instead; on
a cluster that is an error. A written table cuts the lineage and survives lost
executors; Parquet keeps it small and columnar.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets a local one where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="pairlight-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``sweep`` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)  # when the driver ends, if not swept before
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables this process holds; a place for ``sweep`` to start from."""
    return len(_WRITTEN)


def sweep(spark: SparkSession, since: int = 0, but: int = 0) -> int:
    """Delete the tables written after the first ``since``, all but the last ``but``; call it when no result that reads them is needed any more."""
    conf, n = spark._jsc.hadoopConfiguration(), 0
    old = _WRITTEN[since : len(_WRITTEN) - but]
    del _WRITTEN[since : len(_WRITTEN) - but]
    for name in old:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
