"""Session settings, table access and materialisation shared by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "wordloom", memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a session on one machine gets a
    temporary folder, which becomes the setting; a cluster is refused, for its executors would write to their own
    disks."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="wordloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/wordloom/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write df once to the shared folder and read it back.

    Used where several branches read one result: it cuts lineage, outlives lost executors and, unlike a
    checkpoint of rows, stays columnar, so that later reads prune columns. The files go when the
    application ends.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the context may be gone; the folder's owner clears it then
            pass


def latest_by(df: DataFrame, keys: list[str], order: str, payload: list[str]) -> DataFrame:
    """Of each key the row of the latest `order`, as columns keys + payload.

    Partial aggregation runs before the shuffle, so a key that holds a third of all rows sends one row a
    task. Rows with a null key name nothing and drop out; a null `order` counts as earliest; of rows equal
    in `order` a hash of the payload decides, so that any plan picks the same one.
    """
    kept = df.select(*keys, order, *[c for c in payload if c not in {*keys, order}])
    for k in keys:
        kept = kept.where(F.col(k).isNotNull())
    pick = F.max_by(F.struct(*payload), F.struct(F.col(order), F.xxhash64(*payload)))
    return kept.groupBy(*keys).agg(pick.alias("__pick")).select(*keys, *[F.col("__pick")[c].alias(c) for c in payload if c not in keys])


def scalar_of(df: DataFrame) -> Column:
    """The only value of a one-row aggregate, as a scalar subquery: no cross join, no driver action."""
    return df.scalar()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application: they need not have it installed, and
    need not run in the driver's folder."""
    import os
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    place = os.path.join(tempfile.mkdtemp(prefix="wordloom-"), "wordloom.zip")
    with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(place)
    _shipped.add(app)
