"""A keyed table with durable versions and one winner for each of them.

A version is a manifest that names, for each bucket of the keys, the folders with its
rows. A commit writes folders for the buckets that it touches and then its manifest, whose
name only one writer can take. New keys are added as one more folder of a bucket, and folders are merged
when a bucket has :data:`RUNS` of them, so what a commit reads doesn't grow with their number. Whoever loses the race reads the winner's version and
judges its attempts again. Folders that no manifest names are never read, so a writer
that dies before its manifest leaves the last version as it was.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete_path
from . import store


#: Folders of a bucket that are merged.
RUNS = 8


class LostRace(RuntimeError):
    """Other writers took every version that this one tried to make."""


@dataclass
class VersionedStore:
    """Rows (key, value, version) below ``path``, a folder that all writers share.

    ``version`` of a row counts its values from 1; versions of the table count its commits.
    Names of versions are taken by a rename that refuses an existing target (by a hard link on
    local disks, where a rename would replace it); the file system has to make it atomic, as HDFS does.
    """

    spark: SparkSession
    path: str
    key: str
    value: str
    buckets: int = 64

    def versions(self) -> list[int]:
        folder = self._hadoop(f"{self.path}/versions")
        fs = self._fs(folder)
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != ".")

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default."""
        return self._rows(self._manifest(version))

    def create(self, rows: DataFrame) -> int:
        """The first version: one row per key, null keys refused."""
        once = rows.groupBy(self.key).agg(F.count("*").alias("__n"), F.min(self.value).alias(self.value))
        wrong = F.col("__n").cast("int") + F.col(self.key).isNull().cast("int") > 1
        checked = once.withColumn(self.key, F.when(wrong, F.raise_error(F.lit("a key is null or has several rows"))).otherwise(F.col(self.key)))
        fields = {"key": rows.schema[self.key].dataType.simpleString(), "value": rows.schema[self.value].dataType.simpleString()}
        number = self._take({"folders": self._written(checked.select(self.key, self.value, F.lit(1).alias("version"))), "types": fields}, 1)
        if not number:
            raise LostRace(f"{self.path} has versions")
        return 1

    def compare_and_set(
        self, attempts: DataFrame, expected: str, order: str, allowed: Callable[[Column, Column, Column], Column] | None = None, tries: int = 10
    ) -> DataFrame:
        """Commit the winners of :func:`store.compare_and_set` as one version, and return
        the outcomes of all attempts as they were decided, written beside the rows.

        Attempts that lose against another writer are judged again on that writer's version:
        what they expected is no longer stored, so they are stale. A commit without
        winners makes no version.
        """
        return self._commit(attempts, tries, lambda old, new: self._set(old, new, expected, order, allowed))

    def insert_once(self, rows: DataFrame, tries: int = 10) -> DataFrame:
        """Add keys that aren't stored. Returns the rows with their ``outcome``: insert, same
        for an equal value, conflict for another one; nothing is added if any conflicts."""
        return self._commit(rows, tries, self._add)

    def vacuum(self, keep: int = 2) -> None:
        """Drop all but the last ``keep`` versions, and the folders that only they name. Not to be
        called while a writer is at work."""
        kept = self.versions()[-keep:]
        named = {f for v in kept for folders in self._manifest(v)["folders"].values() for f in folders}
        folder = self._hadoop(f"{self.path}/data")
        fs = self._fs(folder)
        for v in self.versions()[:-keep]:
            delete_path(self.spark, self._name(v))
        for made in fs.listStatus(folder):
            if not any(n.startswith(f"data/{made.getPath().getName()}/") for n in named):
                fs.delete(made.getPath(), True)

    # -- one commit ---------------------------------------------------------------

    def _commit(self, attempts: DataFrame, tries: int, judge: Callable) -> DataFrame:
        bucketed = attempts.withColumn("__bucket", self._bucket())
        touched = sorted(r[0] for r in bucketed.select("__bucket").distinct().collect())  # at most ``buckets``
        for _ in range(tries):
            number = (self.versions() or [0])[-1]
            manifest = self._manifest(number)
            old = self._rows(manifest | {"folders": {str(b): f for b, f in manifest["folders"].items() if int(b) in touched}})
            outcomes, new = judge(old, attempts)
            decided = self._kept(outcomes, "outcomes")
            if decided.where(self._changes(decided)).isEmpty():
                return decided
            rows, added = new(decided)
            if self._take(manifest | {"folders": self._placed(manifest, rows, added)}, number + 1):
                return decided
        raise LostRace(f"{tries} versions of {self.path} went to other writers")

    def _set(self, old, attempts, expected, order, allowed):
        outcomes = store.compare_and_set(old, attempts, self.key, self.value, expected, order, allowed)
        return outcomes, lambda decided: (store.committed(old, decided, self.key, self.value, order, "version"), False)

    def _add(self, old, rows):
        spread = rows.groupBy(self.key).agg(F.min(self.value).alias("__lo"), F.max(self.value).alias("__hi"))
        told = store.upsert_outcome(old.select(self.key, self.value), rows, self.key, self.value)
        outcome = F.when(F.col("__lo").eqNullSafe(F.col("__hi")), F.col("outcome")).otherwise("conflict")
        outcomes = told.join(spread, self.key).withColumn("outcome", outcome).drop("__lo", "__hi")

        def new(decided: DataFrame) -> tuple[DataFrame, bool]:
            return decided.where("outcome = 'insert'").groupBy(self.key).agg(F.min(self.value).alias(self.value)).withColumn("version", F.lit(1)), True

        return outcomes, new

    def _changes(self, decided: DataFrame) -> Column:
        """Rows that call for a new version; a conflict keeps all others out."""
        conflict = not decided.where("outcome = 'conflict'").isEmpty()
        return F.lit(False) if conflict else F.col("outcome").isin("committed", "insert")

    # -- files ----------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _written(self, rows: DataFrame) -> dict[str, list[str]]:
        """The folder of each bucket of ``rows``."""
        made = uuid.uuid4().hex
        path = f"{self.path}/data/{made}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(path)
        names = [f.getPath().getName() for f in self._fs(self._hadoop(path)).listStatus(self._hadoop(path))]
        return {n.split("=")[1]: [f"data/{made}/{n}"] for n in names if n.startswith("bucket=")}

    def _placed(self, manifest: dict, rows: DataFrame, added: bool) -> dict[str, list[str]]:
        """Folders of all buckets once ``rows`` are written: beside those of their buckets if they
        are ``added``, or in their place."""
        before, fresh = manifest["folders"], self._written(rows)
        if not added:
            return before | fresh
        folders = before | {b: [*before.get(b, []), *f] for b, f in fresh.items()}
        full = {b: f for b, f in folders.items() if len(f) >= RUNS}
        return folders | self._written(self._rows(manifest | {"folders": full})) if full else folders

    def _rows(self, manifest: dict) -> DataFrame:
        schema = f"`{self.key}` {manifest['types']['key']}, `{self.value}` {manifest['types']['value']}, version int"
        folders = [f"{self.path}/{f}" for runs in manifest["folders"].values() for f in runs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _manifest(self, version: int | None = None) -> dict:
        number = (self.versions() or [0])[-1] if version is None else version
        if not number:
            raise FileNotFoundError(f"{self.path} has no version")
        return json.loads(self.spark.read.text(self._name(number), wholetext=True).first()[0])

    def _name(self, version: int) -> str:
        return f"{self.path}/versions/{version:020d}.json"

    def _take(self, manifest: dict, version: int) -> bool:
        """Publish the manifest as ``version`` unless another writer has."""
        final, staged = self._hadoop(self._name(version)), self._hadoop(f"{self.path}/versions/.{uuid.uuid4().hex}")
        fs = self._fs(final)
        out = fs.create(staged, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                os.link(staged.toUri().getPath(), final.toUri().getPath())
                return True
            if fs.exists(final):
                return False
            return fs.rename(staged, final)
        except FileExistsError:
            return False
        finally:
            fs.delete(staged, False)

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())
