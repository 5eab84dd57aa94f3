"""Session helpers for tests, the bench and scripts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app_name: str = "auditflow") -> SparkSession:
    """A local session for tests and the bench; on a cluster, pass in your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a folder of its own; elsewhere a missing one is an error,
    since a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_auditflow_folder", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        # The setting itself can't be changed in a running session, so the folder is kept beside it.
        configured = context._auditflow_folder = tempfile.mkdtemp(prefix="auditflow-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and read it from there.

    Later actions neither repeat the work nor depend on executors that did it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run. Once per application."""
    context = spark.sparkContext
    if getattr(context, "_auditflow_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="auditflow-package-")) / "auditflow.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._auditflow_shipped = True
