"""A keyed table on a folder with snapshots: changes are written beside the rows and merged when read.

Rows lie in buckets of their key's hash. A commit writes one folder of changed rows (or of keys
to delete) under data/, and then a manifest, a small file that lists the folders and buckets that
make up the table from then on, each with the version that wrote it. Nothing that is there is
rewritten: an upsert writes its own rows, a deletion its keys.

A snapshot is its manifest. Manifests are created without overwriting, one file per version, so of two
writers one gets the version and the other commits again after it; what a lost writer left under
data/ is on no manifest and is never read. On stores without an exclusive create, one writer at
a time is for the caller to ensure.

Reading takes of all changes the newest per key, drops base rows of these keys and adds the changed rows;
buckets without changes are read as they are. Compaction merges the buckets that have changes into
new base rows, and runs by itself when changes outnumber COMPACT_SHARE of the base.

Scale: manifests grow with commits since the last compaction times buckets, not with rows or files. The
merge moves changes and the keys of changed buckets; base rows are joined to changed keys, which
are broadcast as long as they are few.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import file_system

COMPACT_SHARE = 0.5
#: Buckets of a table: one per so many rows of its first commit, between a least and a most.
BUCKET_ROWS, BUCKETS_LEAST, BUCKETS_MOST = 100_000, 4, 4096
_BUCKET, _SEQ, _GONE = "_bucket", "_seq", "_gone"


class CommitConflict(RuntimeError):
    """Another writer committed in between, and again at each attempt."""


@dataclass(frozen=True)
class Folder:
    """Rows of some buckets, as one commit wrote them."""

    name: str
    kind: str  # base, upsert or delete
    version: int
    rows: int
    buckets: tuple[int, ...]


@dataclass(frozen=True)
class Manifest:
    version: int
    key: str
    buckets: int
    schema: str
    folders: tuple[Folder, ...]

    def text(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def of(cls, text: str) -> Manifest:
        told = json.loads(text)
        return cls(**told | {"folders": tuple(Folder(**f | {"buckets": tuple(f["buckets"])}) for f in told["folders"])})


class KeyedTable:
    """Rows by one key under a folder."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # ---- manifests ----

    def versions(self) -> list[int]:
        fs, at = file_system(self.spark, self.path)
        folder = at(f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """Of a version; else the newest that is complete, None before the first commit."""
        for v in [version] if version else reversed(self.versions()):
            text = self._text(f"{self.path}/manifests/v{v:012d}.json")
            try:
                return Manifest.of(text)
            except ValueError:  # a writer has not ended yet, or never did
                continue
        return None

    def _text(self, path: str) -> str:
        fs, at = file_system(self.spark, path)
        stream = fs.open(at(path))
        try:
            return str(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _claim(self, manifest: Manifest) -> bool:
        """Whether this manifest became its version."""
        path = f"{self.path}/manifests/v{manifest.version:012d}.json"
        fs, at = file_system(self.spark, path)
        try:
            stream = fs.create(at(path), False)
        except Py4JJavaError as error:
            if fs.exists(at(path)):
                return False
            raise error
        stream.write(bytearray(manifest.text().encode()))
        stream.close()
        return True

    def _commit(self, change: Callable[[Manifest | None, int], Manifest], attempts: int = 5) -> Manifest:
        for _ in range(attempts):
            version = max(self.versions(), default=0) + 1
            made = change(self.manifest(), version)
            if self._claim(made):
                return made
        raise CommitConflict(f"{self.path}: {attempts} attempts to commit met other writers")

    # ---- folders ----

    def _write(self, rows: DataFrame, buckets: int) -> tuple[str, int, tuple[int, ...]]:
        """Name, rows and buckets of a new folder under data/."""
        name = f"c{uuid.uuid4().hex}"
        at = f"{self.path}/data/{name}"
        told = rows.withColumn(_BUCKET, F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int"))
        told.hint("rebalance", F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(at)
        fs, path = file_system(self.spark, at)
        held = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path(at)) if s.isDirectory())
        return name, self.spark.read.parquet(at).count() if held else 0, tuple(held)

    def _read(self, manifest: Manifest, folders: list[Folder], schema: T.StructType) -> DataFrame:
        wide = T.StructType([*schema.fields, T.StructField(_BUCKET, T.IntegerType())])
        parts = []
        for f in folders:
            rows = self.spark.read.schema(wide).parquet(f"{self.path}/data/{f.name}")
            parts.append(rows.filter(F.col(_BUCKET).isin(list(f.buckets))).withColumn(_SEQ, F.lit(f.version)).withColumn(_GONE, F.lit(f.kind == "delete")))
        empty = self.spark.createDataFrame([], T.StructType([*wide.fields, T.StructField(_SEQ, T.IntegerType(), False), T.StructField(_GONE, T.BooleanType(), False)]))
        return reduce(DataFrame.unionByName, parts) if parts else empty

    # ---- changes ----

    def _checked(self, rows: DataFrame) -> DataFrame:
        twice = rows.groupBy(self.key).count().filter(F.col(self.key).isNull() | (F.col("count") > 1)).first()
        if twice is not None:
            raise ValueError(f"{self.key} {twice[0]} is null or stands more than once")
        return rows

    def replace(self, rows: DataFrame) -> int:
        """rows and nothing else: a new base. Returns the version."""
        held = self.manifest()
        buckets = held.buckets if held else min(BUCKETS_MOST, max(BUCKETS_LEAST, rows.count() // BUCKET_ROWS))
        name, n, met = self._write(self._checked(rows), buckets)

        def change(now: Manifest | None, version: int) -> Manifest:
            return Manifest(version, self.key, buckets, rows.schema.json(), (Folder(name, "base", version, n, met),) if met else ())

        return self._commit(change).version

    def upsert(self, rows: DataFrame) -> int:
        """rows in place of those with equal keys, beside the others."""
        return self.apply(rows, None)

    def delete(self, keys: DataFrame) -> int:
        """Without the rows of these keys; unknown keys change nothing."""
        return self.apply(None, keys)

    def apply(self, rows: DataFrame | None, keys: DataFrame | None) -> int:
        """Upserts and deletions as one commit; a key that is in both is upserted."""
        held = self.manifest()
        if held is None:
            if rows is None:
                raise ValueError(f"no table at {self.path}")
            return self.replace(rows)
        made = []
        if rows is not None:
            rows = self._checked(rows).select(T.StructType.fromJson(json.loads(held.schema)).fieldNames())
            made.append(("upsert", *self._write(rows, held.buckets)))
        if keys is not None:
            keys = keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
            keys = keys if rows is None else keys.join(rows.select(self.key), self.key, "left_anti")
            made.append(("delete", *self._write(keys, held.buckets)))

        def change(now: Manifest | None, version: int) -> Manifest:
            more = [Folder(name, kind, version, n, met) for kind, name, n, met in made if met]
            return replace(now, version=version, folders=(*now.folders, *more))

        after = self._commit(change)
        base = sum(f.rows for f in after.folders if f.kind == "base")
        if sum(f.rows for f in after.folders if f.kind != "base") > COMPACT_SHARE * max(base, 1):
            return self.compact()
        return after.version

    def compact(self) -> int:
        """Changes merged into base rows, in the buckets that have any. Commits made meanwhile stay changes."""
        held = self.manifest()
        touched = {b for f in held.folders if f.kind != "base" for b in f.buckets} if held else set()
        if not touched:
            return held.version if held else 0
        seen = {f.name for f in held.folders}
        name, n, met = self._write(self._merged(held, touched), held.buckets)

        def change(now: Manifest | None, version: int) -> Manifest:
            if not seen <= {f.name for f in now.folders}:
                raise CommitConflict(f"{self.path}: the table was replaced or compacted meanwhile")
            rest = [replace(f, buckets=tuple(b for b in f.buckets if f.name not in seen or b not in touched)) for f in now.folders]
            rest = [replace(f, rows=self._rows(f)) for f in rest if f.buckets]
            return replace(now, version=version, folders=(*((Folder(name, "base", version, n, met),) if met else ()), *rest))

        return self._commit(change).version

    def _rows(self, folder: Folder) -> int:
        return self.spark.read.parquet(f"{self.path}/data/{folder.name}").filter(F.col(_BUCKET).isin(list(folder.buckets))).count()

    # ---- reading ----

    def _merged(self, manifest: Manifest, only: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        folders = [replace(f, buckets=tuple(b for b in f.buckets if only is None or b in only)) for f in manifest.folders]
        folders = [f for f in folders if f.buckets]
        changes = [f for f in folders if f.kind != "base"]
        touched = {b for f in changes for b in f.buckets}
        parts = lambda keep: [g for f in folders if f.kind == "base" and (g := replace(f, buckets=tuple(b for b in f.buckets if (b in touched) == keep))).buckets]
        base = self._read(manifest, parts(False), schema).select(schema.fieldNames())
        if not changes:
            return base
        newest = self._read(manifest, changes, schema).groupBy(self.key).agg(F.max_by(F.struct(*schema.fieldNames(), _GONE), _SEQ).alias("r"))
        changed = self._read(manifest, parts(True), schema).join(newest.select(self.key), self.key, "left_anti").select(schema.fieldNames())
        return base.unionByName(changed).unionByName(newest.filter(~F.col(f"r.{_GONE}")).select(*(F.col("r")[c].alias(c) for c in schema.fieldNames())))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a snapshot, the newest if none is named."""
        held = self.manifest(version)
        if held is None:
            raise ValueError(f"no table at {self.path}")
        return self._merged(held)

    def vacuum(self, keep: int = 1) -> int:
        """Drop all but the newest snapshots, and folders that none of these names; returns how many
        folders went. No reader may be on an older snapshot, and no writer at work."""
        fs, at = file_system(self.spark, self.path)
        versions = [v for v in self.versions() if self.manifest(v) is not None]
        held = {f.name for v in versions[-keep:] for f in self.manifest(v).folders}
        for v in self.versions():
            if v not in versions[-keep:]:
                fs.delete(at(f"{self.path}/manifests/v{v:012d}.json"), False)
        data = at(f"{self.path}/data")
        gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in held] if fs.exists(data) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)
