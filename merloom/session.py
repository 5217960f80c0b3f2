"""Session and table helpers shared by queries, tests and the bench."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench share."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("merloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the test data; a file or a directory of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    A local session without one gets a temporary folder of its own; a cluster
    must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own_folder
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="merloom-")
        atexit.register(shutil.rmtree, _own_folder[7:], ignore_errors=True)
    return _own_folder


_own_folder: str | None = None


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path object) of a path, local or remote."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file (settings, code tables) of any file system."""
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


_app_folders: dict[str, str] = {}


def new_path(spark: SparkSession) -> str:
    """A new folder name within a folder of this application, which goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _app_folders:
        folder = f"{shared_folder(spark).rstrip('/')}/merloom-{app}"
        fs, p = file_system(spark, folder)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _app_folders[app] = folder
    return f"{_app_folders[app]}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a table derived from a costly pass is read more than once; the
    written copy survives the loss of executors and goes when the application ends.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    import merloom

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(merloom.__file__)))
    with tempfile.TemporaryDirectory() as d:
        staged = shutil.copytree(os.path.join(root, "merloom"), os.path.join(d, "src", "merloom"), ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(os.path.join(tempfile.gettempdir(), f"merloom-{app}"), "zip", os.path.dirname(staged))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def measured_broadcasts(spark: SparkSession) -> None:
    """Broadcast sides of joins by their measured size only.

    Estimates do not see how many rows a window or explode generator makes, so
    a static choice may broadcast a table far larger than estimated. The static
    threshold is moved to adaptive execution, which knows the size of a side
    once it is computed. Sides under a broadcast hint are bounded by design.
    """
    static = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if static != "-1":
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", static)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def prepare(spark: SparkSession) -> None:
    """What every query needs of a session."""
    ship_package(spark)
    measured_broadcasts(spark)


#: tables of more rows than this are joined by shuffle
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
