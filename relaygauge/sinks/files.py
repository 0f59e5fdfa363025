"""Small files and folders on the file system that a path names, by Spark's own Hadoop client."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        """Names below a folder, none if it does not exist."""
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """Make a file as a whole, False if there is one of that name.

        The text is written aside and renamed, so nobody reads half of it.  Of several writers one
        succeeds where renames are atomic, as streaming checkpoints ask for too.
        """
        target = self._path(path)
        aside = self._path(f"{target.getParent()}/.{target.getName()}-{self._jvm.java.util.UUID.randomUUID()}")
        stream = self._fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._jvm.java.lang.reflect.Array.newInstance(kind.NONE.getClass(), 1)
        self._jvm.java.lang.reflect.Array.set(options, 0, kind.NONE)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        if self._fs.exists(target):
            self.remove(str(aside))
            return False
        try:
            context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(target), options)
        except Exception:
            if not self._fs.exists(target):
                raise
            self.remove(str(aside))
            return False
        return True

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def size(self, folder: str) -> int:
        return self._fs.getContentSummary(self._path(folder)).getLength()
