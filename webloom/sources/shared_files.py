"""Small files and folders at any path that Spark reads, through its own file systems."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class SharedFiles:
    """Listing, text files that are created once, and removal."""

    def __init__(self, spark: SparkSession):
        self.context = spark.sparkContext
        self.jvm = self.context._jvm
        self.conf = self.context._jsc.hadoopConfiguration()

    def path(self, where: str):
        return self.jvm.org.apache.hadoop.fs.Path(where)

    def system(self, where: str):
        return self.path(where).getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        """Names in a folder; one that is not there has none."""
        fs = self.system(folder)
        return [s.getPath().getName() for s in fs.listStatus(self.path(folder))] if fs.exists(self.path(folder)) else []

    def read(self, where: str) -> str:
        stream = self.system(where).open(self.path(where))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, where: str, text: str) -> bool:
        """Write a file that nobody has written yet, whole or not at all; False when somebody has."""
        fs, final = self.system(where), self.path(where)
        fs.mkdirs(final.getParent())
        draft = self.path(f"{where}.{self.jvm.java.util.UUID.randomUUID()}.draft")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            self._name(fs, draft, final)
            return True
        except Py4JJavaError as exc:
            if "AlreadyExists" not in exc.java_exception.getClass().getName():
                raise
            return False
        finally:
            fs.delete(draft, False)

    def _name(self, fs, draft, final) -> None:
        """Give the draft its final name; fails if the name is taken."""
        if fs.getUri().getScheme() == "file":
            # a local rename replaces a file that is there, a second name for the draft never does
            nio, uri = self.jvm.java.nio.file, lambda p: fs.makeQualified(p).toUri()
            nio.Files.createLink(nio.Paths.get(uri(final)), nio.Paths.get(uri(draft)))
            return
        hadoop = self.jvm.org.apache.hadoop.fs
        refuse = self.context._gateway.new_array(hadoop.Options.Rename, 1)
        refuse[0] = hadoop.Options.Rename.NONE
        hadoop.FileContext.getFileContext(fs.getUri(), self.conf).rename(draft, final, refuse)

    def remove(self, where: str) -> None:
        self.system(where).delete(self.path(where), True)
