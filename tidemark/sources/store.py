"""A store of keyed rows: portfolios, price snapshots. Keys are replaced, cleared or kept; every state is read whole or not at all.

A write is a version: a folder of Parquet with the new rows and, for each key that it settles, a row that says so (its tombstone
for what was there before). A version counts once its number is in the log, a file that is created and never overwritten, so two
writers can't take the same one and a failed write leaves nothing that is read. Of a key the rows of its last version count. A base
version holds everything, so what is older needn't be read; compacting writes one, from the store itself if need be, as no
file that a reader holds is touched. Rows are dealt into buckets by their key's hash, not into a folder for each key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16
_VERSION, _SETTLED, _BUCKET = "__version", "__settled", "__bucket"


class Conflict(RuntimeError):
    """Another writer has taken the version; read again and write anew."""


class Store:
    """Rows under `path`, keyed by the column `key`. The folder may be in any store that Hadoop reads and that can create a file exclusively."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _log(self) -> list[tuple[int, str, str]]:
        """(number, kind, folder) of the versions that count, from the last base on."""
        fs, at = self._fs(f"{self.path}/log")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        found = sorted((int(n), kind, folder) for n, kind, folder in (x.split(".") for x in names))
        last = max((i for i, x in enumerate(found) if x[1] == "base"), default=0)
        return found[last:]

    def _commit(self, number: int, kind: str, folder: str) -> None:
        """The version's name is its log entry. A number is claimed by creating its file, which fails if there is one."""
        fs, claim = self._fs(f"{self.path}/claims/{number}")
        try:
            fs.create(claim, False).close()
        except Exception as e:
            raise Conflict(f"version {number} of {self.path} is taken") from e
        fs.create(self._fs(f"{self.path}/log/{number}.{kind}.{folder}")[1], False).close()

    def _next(self) -> int:
        """The number after all that are taken, by a version that counts or by a writer that failed after its claim."""
        fs, at = self._fs(f"{self.path}/claims")
        return max((int(s.getPath().getName()) for s in (fs.listStatus(at) if fs.exists(at) else [])), default=0) + 1

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        folder = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows.withColumn(_BUCKET, bucket).repartition(self.buckets, _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{folder}")
        self._commit(number, kind, folder)

    def read(self) -> DataFrame:
        """The rows that count now; the frame keeps to this state, whatever is written later. Nothing written: no rows."""
        versions = self._log()
        empty = self.spark.createDataFrame([], self.schema)
        if not versions:
            return empty
        kinds = self.schema + f", {_SETTLED} boolean, {_BUCKET} int"
        parts = [self.spark.read.schema(kinds).parquet(f"{self.path}/data/{folder}").withColumn(_VERSION, F.lit(n)) for n, _, folder in versions]
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        if len(parts) > 1:
            last = rows.groupBy(self.key).agg(F.max(_VERSION).alias("__last"))
            rows = rows.join(last.withColumnRenamed(self.key, "__key"), F.col(self.key).eqNullSafe(F.col("__key")) & (F.col(_VERSION) == F.col("__last")))
        return rows.where(~F.col(_SETTLED)).select(*empty.columns)

    def replace(self, rows: DataFrame, keys: DataFrame | None = None) -> int:
        """A version in which each of keys(key) has these rows alone, and none if there are none; all other keys stay. Returns its number.

        Without keys, those of the rows are replaced. Rows of keys that aren't among the keys given are written too, and replace theirs."""
        number = self._next()
        columns = self.spark.createDataFrame([], self.schema).columns
        own = rows.select(*columns).withColumn(_SETTLED, F.lit(False))
        settled = rows.select(self.key) if keys is None else keys.select(self.key).unionByName(rows.select(self.key))
        marks = settled.distinct().withColumn(_SETTLED, F.lit(True))
        self._write(own.unionByName(marks, allowMissingColumns=True), "delta", number)
        return number

    def compact(self) -> int:
        """A base version of what counts now, so that older ones are read no more. A writer in between makes it fail with Conflict."""
        number = self._next()
        self._write(self.read().withColumn(_SETTLED, F.lit(False)), "base", number)
        return number

    def vacuum(self) -> int:
        """Deletes the folders that no version from the last base on names; how many. Frames read before may still need them."""
        fs, at = self._fs(f"{self.path}/data")
        live = {folder for _, _, folder in self._log()}
        gone = [s.getPath() for s in (fs.listStatus(at) if fs.exists(at) else []) if s.getPath().getName() not in live]
        return sum(1 for p in gone if fs.delete(p, True))
