"""Small files in a folder that all machines share, through Hadoop's FileSystem: any scheme that Spark can write to."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or of the context's checkpoints. There is no machine-local substitute."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        at = tempfile.mkdtemp(prefix="quern-")  # one machine, as in tests
        spark.sparkContext.setCheckpointDir(at)
    return at


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(self._conf)
        self._fs.mkdirs(self._path())

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def names(self, sub: str = "") -> list[tuple[str, int]]:
        """(name, modification time in ms) of what lies in the folder or in ``sub``."""
        p = self._path(sub)
        if not self._fs.exists(p):
            return []
        return sorted((s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(p))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Write a file whole, or not at all; False if ``name`` is there already."""
        if "/" in name:
            self._fs.mkdirs(self._path(name.rsplit("/", 1)[0]))
        tmp = self._path(f".{uuid.uuid4().hex}")
        stream = self._fs.create(tmp)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.getFileSystem(self._conf).getUri(), self._conf).rename(
                self._fs.makeQualified(tmp), self._fs.makeQualified(self._path(name)), none
            )
            return True
        except Py4JJavaError as e:
            self._fs.delete(tmp, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)
