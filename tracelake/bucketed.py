"""A table in buckets of its keys, of which a change rewrites only those that it touches.

A row's bucket is a hash of its keys. A change writes the touched buckets anew, each into a
folder named by the change, and then a version: a small file that lists which folders hold
each bucket. Buckets that no change touches stay where they are, in every later version. Rows
may also be added to their buckets as one more layer, at the cost of these rows alone;
a bucket with many layers is made one by a change. A version's file is renamed into place
as the last step, so what a failed job leaves is never read and the next try overwrites it;
readers keep the version that they opened. One writer at a time: a version that another
wrote meanwhile is an error.

Results by case: a null key has a bucket like any other; a change of no keys writes
nothing and leaves the version as it is; a table without rows keeps its columns and types;
a row put outside the touched buckets is an error, and the version stays.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Column of the bucket in the written folders.
BUCKET = "_bucket"


class BucketedTable:
    """``keys`` and ``buckets`` count where the table is first written; later they are what the table says.

    Without a number a table gets as many buckets as the session has shuffle partitions. A
    bucket should hold some gigabytes: a change costs what the touched ones hold, and a
    version is read with one path for each layer of a bucket.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int | None = None):
        self.spark, self.folder, self.keys = spark, folder, keys
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._known: dict[int, tuple[dict, dict[int, list[int]]]] = {}

    def _path(self, name: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> list[str]:
        path, fs = self._path(name)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _file(self, version: int) -> str:
        return f"{self.folder}/versions/{version}.json"

    def versions(self) -> list[int]:
        """The versions, in order."""
        return sorted(int(n[:-5]) for n in self._listed(f"{self.folder}/versions") if n.endswith(".json") and n[:-5].isdigit())

    def _opened(self, version: int | None = None) -> tuple[int, dict, dict[int, list[int]]] | None:
        """(version, header, bucket -> changes that wrote its layers)."""
        versions = self.versions()
        if not versions:
            return None
        version = versions[-1] if version is None else version
        if version not in self._known:
            path, fs = self._path(self._file(version))
            stream = fs.open(path)
            try:
                told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            self._known = {version: (told["header"], {int(b): c for b, c in told["placed"].items()})}
        header, placed = self._known[version]
        self.keys = header["keys"]
        return version, header, placed

    def _frame(self, header: dict, placed: dict[int, list[int]]) -> DataFrame:
        schema = StructType.fromJson(header["schema"])
        if not placed:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.folder}/changes/{change}/{BUCKET}={bucket}" for bucket, changes in sorted(placed.items()) for change in changes]
        return self.spark.read.schema(schema).parquet(*paths)

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self, version: int | None = None) -> DataFrame | None:
        """The given version, or the latest; None where nothing was ever written."""
        opened = self._opened(version)
        return None if opened is None else self._frame(*opened[1:])

    def bucket_of(self, buckets: int) -> Column:
        """The bucket of a row; keys count as text, so a key has one bucket whatever integer type a frame gives it."""
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(buckets)).cast("int") if self.keys else F.lit(0)

    def _write(self, rows: DataFrame, change: int, buckets: int) -> set[int]:
        """Writes the rows by bucket, where Spark splits large ones and joins small ones; the buckets that have rows."""
        path = f"{self.folder}/changes/{change}"
        dealt = rows.withColumn(BUCKET, self.bucket_of(buckets)).hint("rebalance", BUCKET)
        dealt.write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
        return {int(n.split("=")[1]) for n in self._listed(path) if n.startswith(f"{BUCKET}=")}

    def _commit(self, version: int, schema: StructType, buckets: int, placed: dict[int, list[int]]) -> None:
        header = {"schema": json.loads(schema.json()), "buckets": buckets, "keys": self.keys}
        told = json.dumps({"header": header, "placed": {str(b): c for b, c in sorted(placed.items())}})
        path, fs = self._path(self._file(version))
        aside, _ = self._path(f"{self.folder}/versions/_{version}.tmp")
        out = fs.create(aside, True)
        try:
            out.write(bytearray(told.encode()))
        finally:
            out.close()
        if fs.exists(path) or not fs.rename(aside, path):
            raise RuntimeError(f"version {version} of {self.folder} was written meanwhile")
        self._known = {version: (header, placed)}

    def replace(self, rows: DataFrame) -> None:
        """All rows anew, with the columns that ``rows`` has."""
        opened = self._opened()
        version, buckets = (0, self.buckets) if opened is None else (opened[0] + 1, opened[1]["buckets"])
        written = self._write(rows, version, buckets)
        self._commit(version, rows.schema, buckets, {bucket: [version] for bucket in written})

    def touched(self, keys: DataFrame) -> set[int]:
        """The buckets of the keys, of which there are never more than buckets."""
        opened = self._opened()
        buckets = self.buckets if opened is None else opened[1]["buckets"]
        return {r[0] for r in keys.select(self.bucket_of(buckets).alias("b")).distinct().collect()}

    def part(self, keys: DataFrame) -> DataFrame:
        """The rows of the buckets that the keys touch: all rows of these keys, and some others."""
        _, header, placed = self._open()
        touched = self.touched(keys)
        return self._frame(header, {b: c for b, c in placed.items() if b in touched})

    def layers(self) -> dict[int, int]:
        """How many layers each bucket has."""
        opened = self._opened()
        return {} if opened is None else {bucket: len(changes) for bucket, changes in opened[2].items()}

    def _open(self) -> tuple[int, dict, dict[int, list[int]]]:
        opened = self._opened()
        if opened is None:
            raise KeyError(f"no table in {self.folder}")
        return opened

    @staticmethod
    def _shaped(rows: DataFrame, schema: StructType) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

    def append(self, rows: DataFrame) -> None:
        """The rows as one more layer of their buckets."""
        version, header, placed = self._open()
        schema = StructType.fromJson(header["schema"])
        written = self._write(self._shaped(rows, schema), version + 1, header["buckets"])
        grown = {b: [*placed.get(b, []), version + 1] for b in written}
        self._commit(version + 1, schema, header["buckets"], placed | grown)

    def compact(self, most: int, changed: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Buckets of more than ``most`` layers become one layer."""
        self.change({bucket for bucket, n in self.layers().items() if n > most}, changed)

    def vacuum(self, keep: int = 2) -> list[int]:
        """Takes away all but the last ``keep`` versions, and what only they name; returns the versions taken away.

        Also takes away what failed jobs left, so no change may be under way.
        """
        versions = self.versions()
        gone, kept = versions[: max(len(versions) - keep, 0)], versions[-keep:]
        named = {(change, bucket) for v in kept for bucket, changes in self._opened(v)[2].items() for change in changes}
        for version in gone:
            self._delete(self._file(version))
        for change in [int(n) for n in self._listed(f"{self.folder}/changes") if n.isdigit()]:
            path = f"{self.folder}/changes/{change}"
            if not any(c == change for c, _ in named):
                self._delete(path)
                continue
            for name in self._listed(path):
                if name.startswith(f"{BUCKET}=") and (change, int(name.split("=")[1])) not in named:
                    self._delete(f"{path}/{name}")
        return gone

    def _delete(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)

    def change(self, touched: DataFrame | set[int], changed: Callable[[DataFrame], DataFrame]) -> None:
        """The touched buckets become what ``changed`` makes of the rows that they hold, in one layer.

        ``touched`` has the key columns of every row that is put, changed or taken out, or
        is the set of buckets.
        """
        version, header, placed = self._open()
        touched = touched if isinstance(touched, set) else self.touched(touched)
        if not touched:
            return
        rows = changed(self._frame(header, {b: c for b, c in placed.items() if b in touched}))
        schema = StructType.fromJson(header["schema"])
        written = self._write(self._shaped(rows, schema), version + 1, header["buckets"])
        if written - touched:
            raise ValueError(f"rows outside the touched buckets: {sorted(written - touched)[:5]}")
        kept = {b: c for b, c in placed.items() if b not in touched}
        self._commit(version + 1, schema, header["buckets"], kept | {bucket: [version + 1] for bucket in written})
