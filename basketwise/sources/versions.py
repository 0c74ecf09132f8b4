"""Numbered versions of a stored table, each told by one small manifest that is committed last.

Data files are written under names of their own and never changed. A version is there once its manifest is; what a crash leaves
behind before that is read by nobody. Readers keep the manifest they opened, so a later version changes nothing for them.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class VersionTaken(RuntimeError):
    """Another writer has committed this version."""


class Versions:
    """The manifests below ``path``, in any file system Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self._folder = self._file("versions")
        self._fs = self._folder.getFileSystem(self._conf)

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def latest(self) -> int:
        """The number of the newest version; 0 if there is none."""
        if not self._fs.exists(self._folder):
            return 0
        names = [status.getPath().getName() for status in self._fs.listStatus(self._folder)]
        return max([int(name[1:-5]) for name in names if name.startswith("v") and name.endswith(".json")], default=0)

    def read(self, number: int) -> dict:
        """The manifest of a version."""
        stream = self._fs.open(self._file(f"versions/v{number:08d}.json"))
        try:
            line = self._jvm.java.io.BufferedReader(self._jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
        finally:
            stream.close()
        return json.loads(line)

    def commit(self, number: int, manifest: dict) -> None:
        """Make ``manifest`` version ``number``, whole or not at all; VersionTaken if that exists."""
        target = self._fs.makeQualified(self._file(f"versions/v{number:08d}.json"))
        if self._fs.exists(target):
            raise VersionTaken(f"version {number} of {self.path} exists")
        draft = self._fs.makeQualified(self._file(f"versions/draft-{uuid.uuid4().hex}"))
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest), "utf-8"))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._gateway.new_array(rename, 1)
        options[0] = rename.NONE  # an existing file isn't replaced
        try:
            context.rename(draft, target, options)
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(error.java_exception):
                raise VersionTaken(f"version {number} of {self.path} exists") from None
            raise

    def new_folder(self, kind: str) -> str:
        """A name, relative to the path, for data files to be written."""
        return f"{kind}/{uuid.uuid4().hex}"
