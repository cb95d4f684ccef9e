"""What several operators need: the shared folder, cutting lineage, Arrow maps over documents."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most so many rows of numbers.
BROADCAST_ROWS = 500_000

#: Words are runs of characters other than blanks and the control characters 9 to 13.
GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; where that is
    unset and Spark runs on one machine, as in tests, a new temporary folder that the session keeps."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("agreeline.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("agreeline.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder; later jobs and lost executors reread them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def share_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes bytes to the shared folder and has every executor fetch them from there; gives the name by
    which a task finds its copy on its machine (``pyspark.SparkFiles``)."""
    path, context = new_path(spark, name), spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    context.addFile(path)
    return path.rsplit("/", 1)[1]


_vocabularies: dict[tuple[str, str], str] = {}


def share_vocabulary(spark: SparkSession, path: str) -> str:
    """``share_file`` of a file that the driver has, once for each application; executors need no such path."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _vocabularies:
        _vocabularies[key] = share_file(spark, "vocabulary", Path(path).read_bytes())
    return _vocabularies[key]


def fold(id_column: str, parts: int) -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % parts


def n_words(text: str) -> Column:
    """Words of a text as a Spark expression; null has none."""
    pieces = F.split(F.coalesce(F.col(text), F.lit("")), GAP)
    return F.size(F.filter(pieces, lambda w: w != "")).cast("long")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="spark-code-"), f"{root.name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(path))


def give_back() -> None:
    """Returns memory that a task has freed to the system; workers live on for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library of Linux
    if trim:
        trim(0)


def map_rows(
    df: DataFrame, columns: list[str], work: Callable[[Iterator[dict[str, list]]], Iterator[dict]], schema, piece: int | None = None
) -> DataFrame:
    """Arrow batches of ``columns`` through ``work``, which gets dictionaries of Python lists and
    yields dictionaries of arrays or lists in the order of ``schema``. With ``piece``, ``work`` gets at
    most so many rows at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (b.slice(at, piece) for b in batches for at in range(0, b.num_rows, piece)) if piece else batches
        given = ({c: b.column(i).to_pylist() for i, c in enumerate(columns)} for b in pieces)
        for out in work(given):
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v, pa.Array) else pa.array(v, type=f.type) for v, f in zip(out.values(), target, strict=True)],
                schema=target,
            )
        give_back()

    return df.select(*columns).mapInArrow(run, kind)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, written once, with a broadcast hint if a count shows that it has at most ``rows`` rows;
    larger ones are joined by a shuffle, whose skewed keys adaptive execution splits."""
    df = cut(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
