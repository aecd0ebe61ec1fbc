"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_OWN: list[str] = []
#: Partitions of a shuffle that one task of a light table writes together.
TOGETHER = 8


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a new local one only where none is set on a single machine. A cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="chronofold-"))
        found = _OWN[0]
    return found.rstrip("/")


class Scratch:
    """Cuts lineage by writing a DataFrame as Parquet under the shared folder and reading it back.

    A lost executor loses nothing that was saved. ``drop`` removes a table that no later step reads; what a lazy result
    still needs goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/chronofold/{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}
        atexit.register(self.close)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n}-{name}"

    def save(self, df: DataFrame, name: str, level: int = 3, read_as: StructType | None = None, by: tuple[str, ...] = (), light: bool = False) -> DataFrame:
        """``by``: a directory for each of their values.

        ``light``: little is done after the last shuffle, so each task writes several of its partitions into one file. A file and its folders cost
        calls of the file system; Hadoop's local one starts a process for each, which counts with its executor's whole memory until it runs.
        """
        path = self.path(name)
        if light:
            df = df.coalesce(self.few())
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path, partitionBy=list(by) or None)
        out = self.spark.read.schema(read_as or df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def few(self) -> int:
        """Tasks that write a light table: a share of a shuffle's partitions, so that they grow with it."""
        return max(2 * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // TOGETHER)

    def drop(self, *saved: DataFrame) -> None:
        for df in saved:
            self._delete(self._paths.pop(id(df)))

    def close(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended
            self._delete(self.root)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
