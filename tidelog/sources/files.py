"""Small files by Hadoop's file systems on the driver, and binary files that tasks write by Arrow's."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Folder:
    """Files under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def sizes(self, name: str = "") -> dict[str, int]:
        """Names and bytes of what a folder holds, hidden files apart."""
        if not self._fs.exists(self.at(name)):
            return {}
        return {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self.at(name)) if not s.getPath().getName().startswith(".")}

    def read(self, name: str, most: int | None = None) -> bytes:
        """A file's bytes, or the first of them."""
        stream = self._fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes() if most is None else stream.readNBytes(most))
        finally:
            stream.close()

    def write(self, name: str, data: bytes, replace: bool = False) -> None:
        """Written aside and renamed into place; without replace only where no such file is (FileExistsError), which is
        safe against other writers on stores whose rename does not replace."""
        folder, _, last = name.rpartition("/")
        aside = self.at(f"{folder}/.{last}-{uuid.uuid4().hex}" if folder else f".{last}-{uuid.uuid4().hex}")
        self._fs.mkdirs(self.at(folder))
        out = self._fs.create(aside, False)
        for a in range(0, len(data), 1 << 20):
            out.write(bytearray(data[a : a + (1 << 20)]))
        out.close()
        self._settle(aside, name, replace)

    def replace(self, old: str, new: str) -> None:
        """Old, a file beside it, takes the place of new."""
        self._settle(self.at(old), new, True)

    def _settle(self, aside, name: str, replace: bool) -> None:
        if replace and self._fs.exists(self.at(name)):
            self._fs.delete(self.at(name), False)
        if self._fs.exists(self.at(name)) or not self._fs.rename(aside, self.at(name)):
            self._fs.delete(aside, False)
            raise FileExistsError(f"{self.root}/{name}")

    def rename(self, old: str, new: str) -> None:
        if self._fs.exists(self.at(new)) or not self._fs.rename(self.at(old), self.at(new)):
            raise FileExistsError(f"{self.root}/{new}")

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self.at(name))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self.at(name), True)


def task_stream(root: str, name: str):
    """A binary stream to root/name from inside a task."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(root)
    return system.open_output_stream(f"{path}/{name}")


def task_source(root: str, name: str):
    """A binary stream from root/name inside a task."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(root)
    return system.open_input_stream(f"{path}/{name}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where that is unset and all
    run in one process."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise a small frame in the shared folder, for plans that read it several times."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Workspace:
    """A folder for the time of a `with` block; frames that outlive it go through kept()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        Folder(self.spark, self.root).delete()

    @staticmethod
    def kept(df: DataFrame) -> DataFrame:
        return df.checkpoint()
