"""Session defaults for local work. On a cluster the deployment's own session is used as it is."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, app: str = "verbamill") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VERBAMILL_DRIVER_MEMORY", "8g"))
        .config("spark.checkpoint.dir", os.path.join(tempfile.gettempdir(), "verbamill-checkpoints"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Tables of long texts, on which work is dealt evenly however few parts they come in.
WORDY = ("documents", "pages", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt evenly where a table comes in fewer parts than there are cores to work on them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the base tables; only Spark opens the path."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in WORDY else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python tasks can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_verbamill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    held = tempfile.mkdtemp(prefix="verbamill-code-")
    with zipfile.ZipFile(f"{held}/verbamill_code.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(f"{held}/verbamill_code.zip")
    sc._verbamill_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the cluster names in spark.checkpoint.dir. Where that setting is
    absent, one of our own in local mode alone: other machines could not read what is written there."""
    if kept := spark.conf.get("spark.checkpoint.dir", ""):
        return kept.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return str(Path(tempfile.gettempdir()) / "verbamill-checkpoints")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_folder(spark)}/verbamill/{name}-{uuid.uuid4().hex}"
