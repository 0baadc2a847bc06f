"""Files under keys in one folder of any file system Spark reaches: written whole or not at all, never changed, and never outside the folder."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = re.compile(r"^[A-Za-z0-9][A-Za-z0-9._-]*(/[A-Za-z0-9][A-Za-z0-9._-]*)*$")


class BlobConflict(ValueError):
    """Another content stands under the key already."""


class BlobStore:
    """put writes bytes under a key; the same bytes again are fine, others raise BlobConflict. Keys are parts of letters, digits, dots, dashes and underscores between
    slashes: what could lead out of the folder is no key and raises ValueError."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, key: str):
        if not _KEY.match(key) or ".." in key.split("/"):
            raise ValueError(f"no key: {key!r}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, key: str) -> bool:
        fs, path = self._at(key)
        return fs.exists(path)

    def get(self, key: str) -> bytes:
        fs, path = self._at(key)
        if not fs.exists(path):
            raise FileNotFoundError(key)
        return bytes(self.spark.read.format("binaryFile").load(path.toString()).first()["content"])

    def put(self, key: str, data: bytes) -> str:
        """The content's SHA-256."""
        fs, path = self._at(key)
        digest = hashlib.sha256(data).hexdigest()
        if fs.exists(path):
            if hashlib.sha256(self.get(key)).hexdigest() != digest:
                raise BlobConflict(key)
            return digest
        draft = self._at(f"{key}-{uuid.uuid4().hex}")[1]
        out = fs.create(draft, False)
        out.write(bytearray(data))
        out.close()
        if not fs.rename(draft, path):
            fs.delete(draft, False)
            return self.put(key, data)
        return digest

    def delete(self, key: str) -> bool:
        fs, path = self._at(key)
        return fs.delete(path, False)

    def table(self, pattern: str = "*") -> DataFrame:
        """path, sha256, bytes of the files that match, read by the executors."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(self.root)
        return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
