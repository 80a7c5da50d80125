"""Small files in a folder that driver and executors share, through Hadoop's file system API."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class SharedFolder:
    """Files under ``root`` (any scheme that Spark reads); a path without a scheme lies on the default file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.path("").getFileSystem(self._conf)
        self.scheme = self._fs.getUri().getScheme()

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        """Members of a folder, sorted; none if it doesn't exist."""
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self.path(name))) if self.exists(name) else []

    def age(self, name: str) -> float:
        """Seconds since the file or folder was changed."""
        return (self._jvm.System.currentTimeMillis() - self._fs.getFileStatus(self.path(name)).getModificationTime()) / 1000

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        out = self._fs.create(self.path(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def write(self, name: str, text: str) -> None:
        """Puts ``text`` in place of what is there, by one rename."""
        staged = f"{name}.{uuid.uuid4().hex}.new"
        self._put(staged, text)
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(self._fs.makeQualified(self.path(staged)), self._fs.makeQualified(self.path(name)), options)

    def claim(self, name: str, text: str) -> bool:
        """Makes ``name`` with ``text``, at once and whole; False if it is there already, whoever made it.

        A local file is linked to its name, which the operating system refuses if the name is taken; HDFS
        and the like refuse the rename; an object store has no rename and gets a create that doesn't overwrite.
        """
        self._fs.mkdirs(self.path(name).getParent())
        if self.scheme not in ("file", "hdfs", "viewfs", "webhdfs", "ofs", "maprfs"):
            try:
                self._put(name, text)
            except Exception:
                if self.exists(name):
                    return False
                raise
            return True
        staged = f"{name}.{uuid.uuid4().hex}.new"
        self._put(staged, text)
        try:
            if self.scheme != "file":
                return not self.exists(name) and self._fs.rename(self.path(staged), self.path(name))
            to, source = (self._jvm.java.nio.file.Paths.get(self._fs.makeQualified(self.path(x)).toUri()) for x in (name, staged))
            try:
                self._jvm.java.nio.file.Files.createLink(to, source)
            except Exception:
                if self.exists(name):
                    return False
                raise
            return True
        finally:
            self.remove(staged)

    def remove(self, name: str = "") -> None:
        self._fs.delete(self.path(name), True)

    def load(self, name: str, default=None):
        """A JSON file's value; ``default`` if it is missing or damaged."""
        try:
            return json.loads(self.read(name))
        except Exception:  # a missing file, or one that another program cut short
            return default

    def save(self, name: str, value) -> None:
        self.write(name, json.dumps(value, ensure_ascii=False, indent=1))
