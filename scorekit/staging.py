"""Sessions, and tables written once so that later passes neither recompute nor depend on live executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "scorekit") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller supplies the session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Paths handed out by new_path and not yet removed, in order.
_LIVE: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, from ``spark.checkpoint.dir``.

    Where that is unset, a folder below the warehouse stands in, as executors share the warehouse too. A warehouse on
    a local disk (``file:``) is shared only under a local master, so any other master is refused there; a folder that the
    setting names is taken at its word, since a mounted file system looks like a local one.
    The Spark context's own checkpoint folder is set to the same place if nobody set it.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = context.getCheckpointDir()
    if not root:
        warehouse = context._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir"))
        files = warehouse.getFileSystem(context._jsc.hadoopConfiguration())
        if files.getScheme() == "file" and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = files.makeQualified(warehouse).toString().rstrip("/") + "/_staging"
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _LIVE.append(path)
    return path


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end of the block, what was staged inside it. Results that still read those tables must have been
    written or fetched by then."""
    start = len(_LIVE)
    try:
        yield
    finally:
        for path in _LIVE[start:][::-1]:
            drop_path(spark, path)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result has no lineage above the files: a lost executor costs a re-read, column pruning still reaches
    the scan, and row-to-file placement is fixed. The schema is passed on so that reading infers nothing.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def literal_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A few rows known to the driver, such as a model's summary, as a frame made of literals: no Python workers."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


@contextmanager
def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """``df`` kept by the executors for the length of a block, for exploration. A lost executor's part is recomputed
    from the source; work that must not be repeated belongs in :func:`materialize`."""
    df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def drop_path(spark: SparkSession, path: str) -> bool:
    """Delete a staged table or model that is no longer needed, through the file system that holds it."""
    if path in _LIVE:
        _LIVE.remove(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder, sorted; none if there is no such folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(folder)) if files.exists(folder) else []


def publish(spark: SparkSession, trial: str, final: str) -> bool:
    """Rename a finished folder to its final name; False if that name is taken, also when two writers try at once. Readers
    see either nothing under the name or all of it."""
    fs, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = fs.Path(trial), fs.Path(final)
    files = source.getFileSystem(conf)
    files.mkdirs(target.getParent())
    no_options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        fs.FileContext.getFileContext(files.makeQualified(source).toUri(), conf).rename(files.makeQualified(source), files.makeQualified(target), no_options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        return False
    return True
