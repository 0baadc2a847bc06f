"""Content-addressed snapshots of tables in a shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_hash(df: DataFrame) -> str:
    """A hash of the rows as a multiset: independent of order and partitioning, made by one aggregation. Rows are hashed as JSON with their
    columns in order of name and nulls kept."""
    cols = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    word = lambda k: F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    got = df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(word(k)).alias(f"w{k}") for k in range(4)]).first()
    import hashlib

    return hashlib.sha256("|".join(str(x) for x in got).encode()).hexdigest()


def snapshot_id(label: str, digest: str) -> str:
    return f"SNAP-{label}-{digest[:12].upper()}"


class SnapshotStore:
    """publish writes a table under an id made of its content; the same content is written once, and an id never changes its content.
    Works through the file system Spark uses, so on shared storage of any kind."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, sid: str) -> bool:
        fs, p = self._fs(f"{self.root}/{sid}/_SUCCESS")
        return fs.exists(p)

    def publish(self, df: DataFrame, label: str, make_current: bool = False) -> str:
        """Writes beside the id and renames, so of two writers of one id one wins whole, and readers never see a part."""
        sid = snapshot_id(label, content_hash(df))
        if not self.exists(sid):
            draft = f"{self.root}/_draft-{sid}-{uuid.uuid4().hex}"
            df.write.parquet(draft)
            fs, src = self._fs(draft)
            if not fs.rename(src, self._fs(f"{self.root}/{sid}")[1]):
                fs.delete(src, True)
            elif fs.exists(self._fs(f"{self.root}/{sid}/{src.getName()}")[1]):  # another was there already, and ours went into it
                fs.delete(self._fs(f"{self.root}/{sid}/{src.getName()}")[1], True)
        if make_current:
            self.set_current(sid)
        return sid

    def set_current(self, sid: str) -> None:
        """Points at a published snapshot; FileNotFoundError for any other."""
        if not self.exists(sid):
            raise FileNotFoundError(sid)
        fs, path = self._fs(f"{self.root}/CURRENT")
        out = fs.create(path, True)
        out.write(bytearray(sid.encode()))
        out.close()

    def current(self) -> str | None:
        """The snapshot pointed at, or None."""
        fs, path = self._fs(f"{self.root}/CURRENT")
        if not fs.exists(path):
            return None
        return self.spark.read.text(f"{self.root}/CURRENT").first()[0]

    def open(self, sid: str) -> DataFrame:
        if not self.exists(sid):
            raise FileNotFoundError(sid)
        return self.spark.read.parquet(f"{self.root}/{sid}")

    def verify(self, sid: str) -> bool:
        """Whether the stored rows still have the hash in the id."""
        return content_hash(self.open(sid))[:12].upper() == sid.rsplit("-", 1)[1]

    def list(self) -> list[str]:
        fs, p = self._fs(self.root)
        names = (x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else ()
        return sorted(x for x in names if x.startswith("SNAP-"))
