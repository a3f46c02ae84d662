"""Results, mappings and quality logs as append-only tables; the latest row of a key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.errors import StoreError


def save(rows: DataFrame, path: str, version: int) -> None:
    """Appends a version of the rows; a job that is repeated after a failure overwrites only its own version."""
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")


def load(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """The latest version of each key."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c not in (key, "version")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "version").alias("r")).select(key, "r.*")


def by_status(results: DataFrame, status: str) -> DataFrame:
    """Results of one queue: pending_review, pending, approved, rejected or committed."""
    waits = F.col("needs_review")
    if status == "pending_review":
        return results.where((F.col("status") == "pending") & waits)
    if status == "pending":
        return results.where((F.col("status") == "pending") & ~waits)
    if status in ("approved", "rejected", "committed"):
        return results.where(F.col("status") == status)
    raise ValueError(f"unknown status {status}")


def append_log(snapshots: DataFrame, path: str) -> None:
    """One JSON line for each snapshot (time, tags, figures)."""
    snapshots.write.mode("append").json(path)


def history(spark: SparkSession, path: str, last: int | None = None, tags: dict[str, str] | None = None) -> DataFrame:
    """Snapshots in order of time; all tags must be equal, the last ``last`` of those that fit."""
    log = spark.read.json(path)
    for name, value in (tags or {}).items():
        log = log.where(F.col(f"tags.{name}") == value)
    return log.orderBy("time") if last is None else log.orderBy(F.desc("time")).limit(last).orderBy("time")


KINDS = ("document", "result", "filling", "trace", "mapping")


class Store:
    """Tables of one kind each under a folder; a save is a version, the latest version of a key counts.

    Files are written by Spark's commit protocol, so a reader sees a version whole or not at all.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _path(self, kind: str) -> str:
        if kind not in KINDS:
            raise StoreError(f"unknown kind {kind}")
        return f"{self.base}/{kind}"

    def versions(self, kind: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self._path(kind))
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        return sorted(int(n.partition("=")[2]) for n in (s.getPath().getName() for s in fs.listStatus(where)) if n.startswith("version="))

    def save(self, kind: str, rows: DataFrame) -> int:
        """Appends the rows as the next version."""
        version = max(self.versions(kind), default=0) + 1
        save(rows, self._path(kind), version)
        return version

    def load(self, kind: str, key: str = "doc_id") -> DataFrame | None:
        """The latest row of each key; None if nothing was ever saved."""
        return load(self.spark, self._path(kind), key) if self.versions(kind) else None

    def get(self, kind: str, key_value: object, key: str = "doc_id") -> dict | None:
        """One row, read with its key pushed down to the files; None if there is none."""
        if not self.versions(kind):
            return None
        row = self.spark.read.parquet(self._path(kind)).where(F.col(key) == key_value).orderBy(F.desc("version")).limit(1).drop("version").first()
        return None if row is None else row.asDict(recursive=True)

    def ids(self, kind: str, key: str = "doc_id") -> DataFrame:
        """The keys, sorted."""
        rows = self.load(kind, key)
        return self.spark.createDataFrame([], f"{key} bigint") if rows is None else rows.select(key).orderBy(key)

    def delete_mapping(self, doc_id: object) -> None:
        """Forgets the mapping of a document: every version without it, by writing the rest as a version and dropping older ones."""
        now = self.load("mapping")
        if now is None:
            return
        old = self.versions("mapping")
        save(now.where(F.col("doc_id") != doc_id), self._path("mapping"), max(old) + 1)
        for v in old:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._path('mapping')}/version={v}")
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
