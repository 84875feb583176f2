"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidewatch")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Rows of a batch for Python workers: rows here are whole texts, so fewer than Spark's usual 10,000.
BATCH_ROWS = "2000"


def packed(folder: Path) -> str:
    """The package as a zip below a folder of this machine; its name tells its contents, so a changed package is another file."""
    files = sorted(p for p in Path(ROOT, "tidewatch").rglob("*") if p.is_file() and "__pycache__" not in p.parts)
    digest = hashlib.sha256()
    for p in files:
        digest.update(str(p.relative_to(ROOT)).encode() + p.read_bytes())
    path = folder / f"tidewatch-{digest.hexdigest()[:16]}.zip"
    if not path.exists():
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in files:
                z.write(p, p.relative_to(ROOT))
    return str(path)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep their batches small unless the session says otherwise.

    Executors get a zip of it by Spark's own files; workers of a local session import it from where the driver found it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)
    context = spark.sparkContext
    if context.master.startswith("local["):
        env = context.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
        if ROOT not in paths:
            env["PYTHONPATH"] = ":".join([ROOT, *paths])
    elif getattr(context, "_tidewatch", None) is None:
        context._tidewatch = packed(Path(tempfile.mkdtemp(prefix="tidewatch-")))  # read by the driver, which serves it
        context.addPyFile(context._tidewatch)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
