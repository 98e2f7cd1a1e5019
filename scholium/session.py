"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "scholium", shuffle: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where none is named, a session whose master is this machine gets a folder of
    its own; on a cluster that would be a different folder on every machine, so
    there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder; a cluster needs one that all executors share")
        at = tempfile.mkdtemp(prefix="scholium-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone already; the folder is scratch space
        pass


def _sweep() -> None:
    for spark, path in _written:
        _delete(spark, path)


def release(df: DataFrame) -> None:
    """Delete the files of a ``durable`` table that nothing reads any more."""
    files = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for spark, path in list(_written):
        if any(f.endswith(path.split(":", 1)[-1]) for f in files):
            _written.remove((spark, path))
            _delete(spark, path)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    Cuts the lineage so that a result used several times is computed once, and
    so that losing an executor costs nothing: the files are in shared storage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scholium/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan for costly work row by row: dealt out anew if it has fewer parts than half the cores.

    Such an input is small by definition (less than a file split for every
    second core), so the shuffle is, too; a large scan stays where it is.
    """
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < parts < cores / 2 else df


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    path = f"{shared_dir(spark)}/scholium/{app}/scholium.zip"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)
