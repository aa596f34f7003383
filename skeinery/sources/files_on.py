"""Small files on any Hadoop file system: read, create if absent, replace, list, delete."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.root, self._jvm, self._conf = root.rstrip("/"), spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self._fs = self.path("").getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def read(self, name: str) -> str | None:
        """The file's text; None where there is none (also if it goes just now)."""
        from py4j.protocol import Py4JJavaError

        try:
            stream = self._fs.open(self.path(name))
        except Py4JJavaError as e:
            if e.java_exception.getClass().getName() == "java.io.FileNotFoundException":
                return None
            raise
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str, overwrite: bool) -> None:
        out = self._fs.create(self.path(name), overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def create(self, name: str, text: str) -> bool:
        """Create the file; False where it is there already. Atomic wherever the store's create is."""
        from py4j.protocol import Py4JJavaError

        try:
            self._put(name, text, False)
            return True
        except Py4JJavaError as e:
            if "exist" in f"{e.java_exception.getClass().getName()} {e.java_exception.getMessage()}".lower():
                return False
            raise

    def replace(self, name: str, text: str, aside: str) -> None:
        """Write ``aside`` whole, then rename it to ``name``: readers see the old text or the new."""
        self._put(aside, text, True)
        where = self._fs.makeQualified(self.path(""))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self._conf)
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context.rename(self._fs.makeQualified(self.path(aside)), self._fs.makeQualified(self.path(name)), options)

    def take(self, name: str, aside: str) -> bool:
        """Rename ``name`` away; of several that try, one succeeds."""
        from py4j.protocol import Py4JJavaError

        try:
            return self._fs.rename(self.path(name), self.path(aside))
        except Py4JJavaError:
            return False

    def folders(self, name: str = "") -> list[str]:
        return self._names(name, True)

    def files(self, name: str = "") -> list[str]:
        return self._names(name, False)

    def _names(self, name: str, folders: bool) -> list[str]:
        where = self.path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where) if s.isDirectory() == folders) if self._fs.exists(where) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def size(self, name: str) -> int:
        """Bytes under a folder."""
        return self._fs.getContentSummary(self.path(name)).getLength() if self.exists(name) else 0
