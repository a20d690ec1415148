"""Intermediate tables in the folder every executor shares, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
HOT_KEYS = 20_000
HOT_ROWS = 1024
FILES = 20_000
BIT_WORDS = 2_000_000

_fallback: list[str] = []
_paths: dict[str, None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; in a single-machine session without one, a fresh local folder.

    A cluster whose session names no folder is an error, as executors could
    not read each other's files. The local folder is removed when the
    interpreter exits.
    """
    base = spark.conf.get(_KEY, None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"{master}: set {_KEY} to a folder that the driver and all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="wavelattice-"))
        atexit.register(shutil.rmtree, _fallback[0], ignore_errors=True)
    return f"file://{_fallback[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call returns."""
    path = f"{shared_dir(spark)}/wavelattice/{name}-{uuid.uuid4().hex}"
    _paths[path] = None
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, survives lost executors and gives later jobs identical rows
    however often a task is retried. ``discard`` removes the table.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing reads any more."""
    for table in tables:
        drop_path(table.sparkSession, table.stored_at)


def clean_up(spark: SparkSession) -> None:
    """Remove all intermediates of this interpreter; results that still read them lazily are lost."""
    for path in list(_paths):
        drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder made with new_path through Spark's own file system layer."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    _paths.pop(path, None)


def posix_path(uri: str) -> str:
    """The mounted path behind a ``file:`` URI; other schemes cannot be memory-mapped."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:") :].lstrip("/")
    if "://" in uri:
        raise ValueError(
            f"{uri}: a memory-mapped model needs a shared folder mounted on every executor; "
            "point spark.checkpoint.dir at a file: path on the shared mount"
        )
    return uri


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table that is a literal of the plan."""
    names = [f.split()[0] for f in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    fields = ",".join(f.replace(" ", ":") for f in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>")))


def with_row_key(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a column of numbers that tell all its rows apart however often it is read, and its name.

    Rows read straight from at most FILES Parquet files are numbered by file
    and place; those of any other plan are written to the shared folder with
    their numbers.
    """
    key = unused(df, "_row")
    if "ParquetFileFormat" in _scan_of(df) and "_metadata" not in df.columns:
        paths = [r[0] for r in df.select("_metadata.file_path").distinct().orderBy("file_path").limit(FILES + 1).collect()]
        if len(paths) <= FILES:
            file, base = unused(df, "_row_file"), unused(df, "_row_base")
            numbers = literal_table(df.sparkSession, [(x, i << 36) for i, x in enumerate(paths)], f"{file} string, {base} long")
            keyed = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(key))
            keyed = keyed.join(F.broadcast(numbers), file)
            return keyed.select(*df.columns, (F.col(base) + F.col(key)).alias(key)), key
    return materialise(df.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def pick_rows(keyed: DataFrame, key: str, rows: DataFrame, stay: bool) -> DataFrame:
    """The rows of ``keyed`` whose ``key`` is among those of ``rows`` (``stay``), or is not.

    ``rows`` travels as words of 64 bits, a bit for each row, so the rows of
    ``keyed`` stay where they are at any size of their texts. Beyond BIT_WORDS
    words both sides are shuffled instead.
    """
    word, bits = unused(keyed, "_word"), unused(keyed, "_bits")
    words = rows.select(F.shiftright(key, 6).alias(word), F.expr(f"shiftleft(1L, cast(`{key}` & 63 as int))").alias(bits))
    words = materialise(words.groupBy(word).agg(F.bit_or(bits).alias(bits)), "row-bits")
    if words.count() > BIT_WORDS:
        return keyed.join(rows, key, "left_semi" if stay else "left_anti")
    marked = keyed.withColumn(word, F.shiftright(key, 6)).join(F.broadcast(words), word, "inner" if stay else "left")
    is_in = F.coalesce(F.getbit(bits, F.col(key).bitwiseAND(F.lit(63))) == 1, F.lit(False))
    return marked.where(is_in if stay else ~is_in)


def _scan_of(df: DataFrame) -> str:
    """The file format that ``df`` reads, where it is a table read from files and nothing else."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return ""
    return plan.relation().fileFormat().getClass().getSimpleName()


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has each key once and in ``size`` its number of rows.

    The groups that hold more than one row in HOT_KEYS (``total`` is the number
    of rows), and at least HOT_ROWS, are at most HOT_KEYS; they are broadcast,
    so the rows of a hot key stay where they are. All others are shuffled.
    """
    hot = F.col(size) > max(HOT_ROWS, total // HOT_KEYS)
    few = F.broadcast(groups.where(hot))
    cold = rows.join(F.broadcast(groups.where(hot).select(*keys)), keys, "left_anti").join(groups.where(~hot), keys)
    return rows.join(few, keys).unionByName(cold)
