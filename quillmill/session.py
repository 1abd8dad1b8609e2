"""Session helpers: local sessions for tests, the shared folder, cutting lineage through it."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "quillmill", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tuned for (AQE on, UTC, Arrow)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent (a local test session) a temporary folder is made and kept
    in the session's runtime settings, so it is the same one for every later call.
    """
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("quillmill.shared.dir", "")
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="quillmill-")
        spark.conf.set("quillmill.shared.dir", d)
    return d


#: Tables written by cut: application, weak reference to the file index that all plans on it share, folder.
_written: list[tuple[str, object, str]] = []


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back.

    The result no longer depends on the plan or on any executor that made it; compressed columnar
    files take a fraction of the space a checkpoint of rows would. The table is deleted once no plan
    refers to it any more (see :func:`sweep`), at the latest at the end of the program.
    """
    spark = df.sparkSession
    sweep(spark)
    path = os.path.join(shared_dir(spark), "quillmill", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    index = out._jdf.queryExecution().analyzed().relation().location()
    _written.append((spark.sparkContext.applicationId, spark.sparkContext._jvm.java.lang.ref.WeakReference(index), path))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession, collect: bool = False) -> int:
    """Delete the tables of :func:`cut` that nothing refers to any more; how many are left.

    A table goes only when the JVM has collected the file index that every plan on it shares, so a DataFrame that
    is still held, or derived from one, keeps its files. With ``collect`` both garbage collectors run first.
    """
    app = spark.sparkContext.applicationId
    for attempt in range(4 if collect else 1):
        if collect:
            gc.collect()
            spark.sparkContext._jvm.System.gc()
        for entry in [w for w in _written if w[0] == app and w[1].get() is None]:
            _written.remove(entry)
            _delete(spark, entry[2])
        left = sum(w[0] == app for w in _written)
        if not left or attempt == 3 or not collect:
            break
        time.sleep(0.3)  # the collectors work in the background
    return left


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for app, _, path in _written:
        if app == spark.sparkContext.applicationId:
            _delete(spark, path)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan (no join or aggregate) with at least one partition a core, for passes heavy on CPU.

    Large inputs have more partitions than cores and stay as they are, without a shuffle; only an input of a
    few small files is dealt out.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores else scan.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="quillmill-code-"), "quillmill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
