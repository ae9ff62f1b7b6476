"""Session helpers: a local session for tests, shared scratch space, and shipping this package to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: str = "8", app: str = "gapwright", partitions: int = 8) -> SparkSession:
    """A local session with UTC time, AQE and few shuffle partitions, for tests and benches."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application (what ``--py-files`` does)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="gapwright-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "gapwright_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.join("gapwright", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``. Only where that is unset (tests) a local folder is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        else:
            base = tempfile.mkdtemp(prefix="gapwright-checkpoint-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/gapwright-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into shared space and read it again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables between the steps of one operator: each has a name and goes, by ``drop``, after its last use."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame, codec: str | None = None) -> DataFrame:
        """``df`` written and read again; an older table of that name, which ``df`` may still read, goes then."""
        path = shared_dir(self.spark)
        out = written(df, path, codec)
        self.drop(name)
        self.paths[name] = path
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                remove(self.spark, path)

    def close(self) -> None:
        self.drop(*list(self.paths))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
