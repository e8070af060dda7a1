"""Session helpers: a local session for tests and benches, and lineage cuts in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "tallyforge") -> SparkSession:
    """A session for a single machine. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TALLYFORGE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a folder is made, but only in local mode: on a cluster a machine-local folder would not
    outlive an executor.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage, and they survive the loss of any executor.

    Results are lazy and may read them long after an operator returned, so they stay until ``close`` or until the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self._serial = 0
        self._paths: dict[int, str] = {}
        p, fs = self._at(self.root)
        fs.deleteOnExit(p)

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return it as read back."""
        self._serial += 1
        path = f"{self.root}/{self._serial}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def free(self, *frames: DataFrame | None) -> None:
        """Delete tables of this scratch that nothing reads any more."""
        for f in frames:
            path = self._paths.pop(id(f), None) if f is not None else None
            if path:
                p, fs = self._at(path)
                fs.delete(p, True)

    def close(self) -> None:
        """Delete all tables of this scratch."""
        self._paths.clear()
        p, fs = self._at(self.root)
        fs.delete(p, True)
