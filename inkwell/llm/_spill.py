"""Where the operators keep intermediate tables: the shared folder of the session."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Stands for a null id while ids travel as plain numbers.
NO_ID = -(1 << 63)


def with_ids(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long, NO_ID for null), text and the columns named."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text", *more)


def null_ids(found: DataFrame, *columns: str) -> DataFrame:
    return found.withColumns({c: F.nullif(F.col(c), F.lit(NO_ID)) for c in ("doc_id", *columns)})


def workdir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session where that is unset gets a new one, a cluster must name it."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not held:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        held = found.get() if found.isDefined() else None
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        held = tempfile.mkdtemp(prefix="inkwell-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the folder is the cluster's to clean
        pass


def forget(spark: SparkSession, path: str, table: str | None = None) -> None:
    if table:
        with contextlib.suppress(Exception):  # the session may be gone
            spark.sql(f"DROP TABLE IF EXISTS {table}")
    remove(spark, path)


_made: list[list[tuple[str, str | None]]] = []


def _register(spark: SparkSession, path: str, table: str | None = None) -> None:
    """``path`` goes at exit, or when the :func:`settled` around it ends; with it the catalog's entry ``table``."""
    if _made:
        _made[-1].append((path, table))
    atexit.register(forget, spark, path, table)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()`` as a table; the tables that were written for it, which nothing else reads, go."""
    _made.append([])
    try:
        out = make()
        more = _made.pop()
        _made.append([])
        table = written(out, name)
    finally:
        own = _made.pop()
    if _made:
        _made[-1].extend(own)
    for path, entry in more:
        forget(spark, path, entry)
    return table


def source_bytes(df: DataFrame) -> int:
    """What the optimiser takes for the size of ``df`` in bytes: that of its files where it reads such; 0 where it can't tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def discard(table: DataFrame) -> None:
    """Deletes a table of :func:`written` or :func:`bucketed` that nothing reads any more."""
    files = table.inputFiles()
    if files:
        remove(table.sparkSession, files[0].rsplit("/", 1)[0])


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Within it, a query's shuffle files go when it ends: what it wrote is read from the table."""
    held = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, held)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{workdir(spark)}/inkwell-{uuid.uuid4().hex}/{name}"
    with tidy(spark):
        df.write.option("compression", compression).parquet(path)
    _register(spark, path.rsplit("/", 1)[0])
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` as a table bucketed by ``key`` in the shared folder, so that later groupings by ``key`` move only the other side."""
    spark = df.sparkSession
    table = f"inkwell_{name}_{uuid.uuid4().hex}"
    path = f"{workdir(spark)}/{table}"
    with tidy(spark):
        df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    _register(spark, path, table)
    return spark.table(table)


#: The most files whose first numbers are broadcast, some 100 bytes each.
FILES = 1 << 18


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number of its own for every row, from 0, which stays the same each time it is read.

    Numbers are places in the Parquet files, so nothing is written where ``docs`` is read from such; else it is first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place")]
    try:
        if plan.getClass().getSimpleName() != "LogicalRelation":
            raise AnalysisException("not a table of files")
        found = docs.select("*", *place)
    except AnalysisException:
        found = written(docs, "numbered").select("*", *place)
    sizes = found.groupBy("_file").agg((F.max("_place") + 1).alias("n")).limit(FILES + 1).collect()
    if len(sizes) > FILES:  # so that the table of files stays small: a scan's tasks write fewer, and larger ones
        return numbered(written(docs, "fewer"), name)
    starts, total = [], 0
    for r in sorted(sizes, key=lambda r: r["_file"]):
        starts.append((r["_file"], total))
        total += r["n"]
    table = docs.sparkSession.createDataFrame(starts, "_file string, _start long")
    return found.join(F.broadcast(table), "_file").withColumn(name, F.col("_start") + F.col("_place")).select(*docs.columns, name)
