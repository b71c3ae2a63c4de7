"""A store of versioned snapshots with an atomic switch (K1, K5, K8, K9).

Data files are written to folders of their own and are never changed. What is valid is told by
manifests, numbered files of which the newest counts: a write first puts all its files in place
and then adds the next manifest by one rename that fails if somebody else added it. So a write
that dies leaves the former state whole, and a reader that is pinned to a version goes on
reading it. A manifest lists, per key (a slot or a log) and hash bucket, the folders to read,
the schema and the ids of the batches that were appended; it has no row counts or values, and its
size follows the number of keys and buckets, because compaction folds folders.

Writers compete by the manifest's number: the loser reads the new state and tries again, unless
the winner changed the same key. ``vacuum`` removes the manifests beyond the newest few and every
folder that none of the rest refers to, including what died writers left behind.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "__bucket"


class WriteConflict(RuntimeError):
    """Another writer changed the same key meanwhile."""


@dataclass(frozen=True)
class Part:
    """What a key holds: folders by bucket, the schema of its rows, its bucket column, appended batches."""

    buckets: dict[str, list[str]]
    schema: str
    by: str | None = None
    number: int = 1
    batches: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Version:
    number: int
    parts: dict[str, Part]


class SnapshotStore:
    """Tables by key below one folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = hadoop.Path(self.path)
        self._files = root.getFileSystem(self._conf)
        self._context = hadoop.FileContext.getFileContext(root.toUri(), self._conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        self._files.mkdirs(hadoop.Path(f"{self.path}/manifests"))

    # -------------------------------------------------------------- versions

    def _numbers(self) -> list[int]:
        names = [status.getPath().getName() for status in self._files.listStatus(self._path(f"{self.path}/manifests"))]
        return sorted(int(name) for name in names if name.isdigit())

    def version(self, number: int | None = None) -> Version:
        """The newest state, or an older one that ``vacuum`` has not removed."""
        if number is None:
            numbers = self._numbers()
            if not numbers:
                return Version(0, {})
            number = numbers[-1]
        stream = self._files.open(self._path(f"{self.path}/manifests/{number:012d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(number, {key: Part(**part) for key, part in json.loads(text).items()})

    def _publish(self, number: int, parts: dict[str, Part]) -> bool:
        """Add a manifest; False if another writer has added that number."""
        draft = self._path(f"{self.path}/manifests/.draft-{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        stream.write(bytearray(json.dumps({key: vars(part) for key, part in parts.items()}).encode()))
        stream.close()
        try:
            self._context.rename(draft, self._path(f"{self.path}/manifests/{number:012d}"), self._no_overwrite)
        except Py4JJavaError as error:
            self._files.delete(draft, False)
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise
        return True

    def _commit(self, key: str, before: Version, change: Callable[[Part | None], Part | None]) -> int:
        """Switch to the next version; ``change`` gives the key's new part (None: the key goes)."""
        while True:
            now = self.version()
            if now.parts.get(key) != before.parts.get(key):
                raise WriteConflict(f"{key} was changed by another writer")
            parts = dict(now.parts)
            new = change(parts.pop(key, None))
            if new is not None:
                parts[key] = new
            if self._publish(now.number + 1, parts):
                return now.number + 1

    # -------------------------------------------------------------- reading

    def read(self, key: str, version: Version | None = None, buckets: Sequence[str] | None = None) -> DataFrame:
        """Rows of a key as of one version; the folders are fixed when this is called."""
        part = (version or self.version()).parts.get(key)
        if part is None:
            raise KeyError(key)
        folders = [folder for name, found in part.buckets.items() if buckets is None or name in buckets for folder in found]
        schema = T.StructType.fromJson(json.loads(part.schema))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{folder}" for folder in folders])

    def keys(self, version: Version | None = None) -> list[str]:
        return sorted((version or self.version()).parts)

    # -------------------------------------------------------------- writing

    def _write(self, rows: DataFrame, by: str | None, number: int) -> dict[str, list[str]]:
        """Put rows into new folders, by bucket; nothing refers to them yet."""
        name = uuid.uuid4().hex
        if by is None:
            rows.write.parquet(f"{self.path}/data/{name}")
            return {"": [name]}
        dealt = rows.withColumn(BUCKET, self._bucket(F.col(by), number)).repartition(number, BUCKET)
        dealt.write.partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
        found = [status.getPath().getName() for status in self._files.listStatus(self._path(f"{self.path}/data/{name}")) if status.isDirectory()]
        return {folder.split("=")[1]: [f"{name}/{folder}"] for folder in found}

    @staticmethod
    def _bucket(key: Column, number: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(number)).cast("int")

    def replace(self, key: str, rows: DataFrame) -> int:
        """The key holds these rows and nothing else from the returned version on."""
        before = self.version()
        buckets = self._write(rows, None, 1)
        return self._commit(key, before, lambda old: Part(buckets, rows.schema.json()))

    def remove(self, key: str) -> int:
        """The key is gone from the returned version on; its files go with ``vacuum``."""
        return self._commit(key, self.version(), lambda old: None)

    def append(
        self, key: str, rows: DataFrame, batch: str, unique: Sequence[str], first_by: Sequence[str] = (), buckets: int = 32
    ) -> bool:
        """Append the rows whose ``unique`` values are not stored yet; of equal ones in ``rows`` the least by ``first_by`` counts.

        A batch id that was appended before changes nothing (False). Rows are dealt by a hash of the first unique column.
        """
        before = self.version()
        part = before.parts.get(key)
        if part is not None and batch in part.batches:
            return False
        number = part.number if part is not None else buckets
        rest = [*first_by, *[name for name in rows.columns if name not in unique and name not in first_by]]
        fresh = rows.groupBy(*unique).agg(F.min(F.struct(*rest)).alias("first")).select(
            *unique, *[F.col(f"first.`{name}`").alias(name) for name in rest]
        ).select(*rows.columns)
        if part is not None:
            stored = self.read(key, before).select(*[F.col(name).alias(f"__{name}") for name in unique])
            same = [F.col(name).eqNullSafe(F.col(f"__{name}")) for name in unique]
            fresh = fresh.join(stored, reduce(Column.__and__, same), "left_anti")
        new = self._write(fresh, unique[0], number)

        def added(old: Part | None) -> Part:
            found = {name: list(folders) for name, folders in (old.buckets if old else {}).items()}
            for name, folders in new.items():
                found.setdefault(name, []).extend(folders)
            return Part(found, rows.schema.json(), unique[0], number, [*(old.batches if old else []), batch])

        self._commit(key, before, added)
        return True

    def _rewritten(self, key: str, before: Version, names: Sequence[str], rows: DataFrame) -> int:
        """Replace the named buckets of a key by these rows."""
        part = before.parts[key]
        new = self._write(rows, part.by, part.number)
        kept = {name: folders for name, folders in part.buckets.items() if name not in names}
        return self._commit(key, before, lambda old: Part(kept | new, part.schema, part.by, part.number, part.batches))

    def retain(self, key: str, keep: DataFrame) -> int | None:
        """Drop the rows whose bucket column is not in ``keep``; only buckets that lose rows are written anew.

        Returns the new version, or None if nothing had to go.
        """
        before = self.version()
        part = before.parts[key]
        rows = self.read(key, before)
        gone = rows.join(keep.select(part.by).distinct(), part.by, "left_anti")
        hit = gone.select(self._bucket(F.col(part.by), part.number).alias(BUCKET)).distinct()
        # At most one value a bucket.
        names = [str(row[BUCKET]) for row in hit.collect()]
        if not names:
            return None
        left = self.read(key, before, names).join(keep.select(part.by).distinct(), part.by, "left_semi")
        return self._rewritten(key, before, names, left.select(*rows.columns))

    def compact(self, key: str, most: int = 4) -> int | None:
        """Fold the buckets that lie in more than ``most`` folders into one folder each."""
        before = self.version()
        names = [name for name, folders in before.parts[key].buckets.items() if len(folders) > most]
        return self._rewritten(key, before, names, self.read(key, before, names)) if names else None

    def expire(self, expires_at: dict[str, float], now: float) -> list[str]:
        """Remove the keys whose time has come; returns them."""
        gone = [key for key in self.keys() if key in expires_at and expires_at[key] <= now]
        for key in gone:
            self.remove(key)
        return gone

    def vacuum(self, versions: int = 2, grace: float = 24 * 3600.0) -> int:
        """Delete manifests beyond the newest few and the folders none of the rest names; returns the folders deleted.

        Folders younger than ``grace`` seconds may belong to a writer that has not switched yet and stay.
        """
        numbers = self._numbers()
        for number in numbers[: max(0, len(numbers) - versions)]:
            self._files.delete(self._path(f"{self.path}/manifests/{number:012d}"), False)
        named = {
            folder for number in self._numbers() for part in self.version(number).parts.values()
            for folders in part.buckets.values() for folder in folders
        }
        deleted, data = 0, self._path(f"{self.path}/data")
        if not self._files.exists(data):
            return 0
        for status in self._files.listStatus(data):
            name = status.getPath().getName()
            if time.time() - status.getModificationTime() / 1000 < grace:
                continue
            if not any(folder == name or folder.startswith(f"{name}/") for folder in named):
                deleted += bool(self._files.delete(status.getPath(), True))
                continue
            for inner in self._files.listStatus(status.getPath()):
                if inner.isDirectory() and f"{name}/{inner.getPath().getName()}" not in named:
                    deleted += bool(self._files.delete(inner.getPath(), True))
        return deleted


def slot_key(dataset_id: str, provider: str, kind: str) -> str:
    return f"{dataset_id}/{provider}/{kind}"
