"""Session, table and checkpoint helpers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: str | int = "*", app: str = "postgrain", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE); a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers (a zip that the driver serves), so that they needn't have it installed."""
    sc = spark.sparkContext
    if any(os.path.basename(f) == "postgrain.zip" for f in sc._python_includes):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    # the driver's own copy, which it serves to the workers; nothing is read back from this folder
    target = os.path.join(tempfile.mkdtemp(prefix="postgrain-ship-"), "postgrain.zip")
    with open(target, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(target)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the cluster names; a temporary one only in local mode, an error elsewhere."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), "postgrain-checkpoints")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder, its lineage cut. Survives the loss of executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(f"{checkpoint_root(spark)}/{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)
