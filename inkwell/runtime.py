"""Session-level helpers: the shared checkpoint folder and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only where the session names none and all its tasks run on this
    machine (a local master, as in tests) a local folder is made and set; a cluster without one is an error, since rows
    written to the executors' own disks would be lost."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not is_local(sc.master):
        raise RuntimeError("the cluster names no shared folder: set spark.checkpoint.dir")
    sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-inkwell-"))
    return sc._jsc.sc().getCheckpointDir().get()


def is_local(master: str) -> bool:
    """Does a session with this master run all its tasks on one machine? ``local-cluster`` starts executors of its own."""
    return master == "local" or master.startswith("local[")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so that a lost executor costs a read and no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder, read back: cuts the lineage like ``checkpoint``, in a compact form for rows
    that several branches of a plan read."""
    path = scratch_path(df.sparkSession, "table")
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a side of a join is broadcast.
SMALL_ROWS = 50_000


def small(df: DataFrame, counted: DataFrame | None = None, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it (or ``counted``, a cheaper frame that is no smaller) has at most ``most`` rows; otherwise as
    it is, so that the join shuffles. The count stops at one row more."""
    return F.broadcast(df) if (df if counted is None else counted).limit(most + 1).count() <= most else df
