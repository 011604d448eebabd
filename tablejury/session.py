"""Session settings and the shared folder that intermediate tables go to."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name="tablejury", cores="*", shuffle_partitions=None, **extra):
    """A local session for tests and the bench; a cluster supplies its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), str(value))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark, purpose):
    """A fresh path below the checkpoint folder the cluster names.

    Only a local master may fall back to a temporary folder: on a cluster the
    executors would not see it, so an unset folder is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="tablejury-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tablejury/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def dropping_shuffles(spark):
    """What is written inside leaves no shuffle files behind; else they stay until the driver happens to collect its garbage.

    Only for writes: a frame made inside and collected twice would miss them.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_table(df: DataFrame, purpose: str, rows_per_file: int = 0) -> DataFrame:
    """Write once to the shared folder and read back; files of at most so many rows, if given, let as many tasks read.

    The result has no lineage to recompute when executors are lost, and its
    true file size is known, so the planner broadcasts it only if it is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns) -> DataFrame:
    """Hash-partition into as many parts as the session shuffles into, kept apart by adaptive execution.

    For steps whose work per row far exceeds its size (draws, Python, distance
    blocks), where merging small partitions would leave one task to do it all.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *columns)


def literal_table(spark, rows, names) -> DataFrame:
    """A small fixed table as literal values: planned in the JVM, of known size, without a Python job."""
    def literal(v):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(f'`{n}`' for n in names)})")
