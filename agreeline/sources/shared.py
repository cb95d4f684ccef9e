"""What tables go through between jobs: rows written once to the folder that driver and executors
share, and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 200_000
#: How shuffles of large tables are cut: into so many partitions to begin with (more than 200 would be sorted in the
#: memory of the writing tasks), which adaptive execution joins up to a size in which a task's memory is small.
PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SPREAD = {PARTS: "200", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


def shared(spark: SparkSession) -> None:
    """Sets the folder that driver and executors share, ``spark.checkpoint.dir``; only where that is unset and
    Spark runs on one machine, as in tests, a temporary folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, checkpointed in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_spread(df: DataFrame) -> DataFrame:
    """``cut``, its shuffles cut by size (``SPREAD``) rather than into the session's number of partitions, so that what a
    task joins, sorts or groups doesn't grow with the rows. A session that begins with more partitions keeps them."""
    conf = df.sparkSession.conf
    before = {name: conf.get(name, None) for name in SPREAD}
    settings = SPREAD | {PARTS: max(SPREAD[PARTS], before[PARTS] or conf.get("spark.sql.shuffle.partitions"), key=int)}
    for name, value in settings.items():
        conf.set(name, value)
    try:
        return cut(df.select("*"))  # planned anew, with these settings
    finally:
        for name in settings:
            conf.unset(name) if before[name] is None else conf.set(name, before[name])


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    shared(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as Parquet to the shared folder; readers of a few columns read only those."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df``, which should be written or cheap to count, has at most ``rows`` rows."""
    return df.limit(rows + 1).count() <= rows


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, written once, with a broadcast hint if it has at most ``rows`` rows; larger ones are joined
    by a shuffle, whose skewed keys adaptive execution splits."""
    df = cut(df)
    return F.broadcast(df) if is_small(df, rows) else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once for each application."""
    if (app := spark.sparkContext.applicationId) not in _shipped:
        _shipped.add(app)
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="spark-code-"), f"{root.name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(path))
