"""Sharding by size-tiered compaction, under a versioned manifest.

A store is a folder with immutable Parquet shards and manifests. An arrival is written as small shards, one for each
task, without a shuffle. compact() puts shards in tiers of similar size and merges runs of a tier into files of a target
size, each by one task that reads just its run, again without a shuffle. Every change is a new manifest version,
committed by an atomic rename that fails if that version exists, so readers see a version whole or not at all; a writer
that comes second takes the newer version as its base and tries again. A version names only the shards that it adds and
removes; every SNAPSHOT versions one names all. Shards of a lost attempt are in no version.

An arrival may have a name. A version says which named arrivals it adds, and one that is in the store is not added again:
a run that was lost between two arrivals, or inside one, is run again as it is and adds what is missing.

Renames without overwriting are atomic on HDFS and on local file systems. Object stores without them need a file system
connector that has conditional writes.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES, FANOUT = 128 << 20, 4
#: Arrivals that shard() commits one after another.
ARRIVALS = 4
#: Merged files that one job writes: bounds the size of its plan, not of the data.
MERGES_A_JOB = 128
#: Versions from one that names all shards to the next.
SNAPSHOT = 16


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int
    tier: int


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.folder, self.target, self.fanout = spark, folder.rstrip("/"), target_bytes, fanout

    # -- manifests ------------------------------------------------------------------------------------------------

    def _hadoop(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _file(self, version: int) -> str:
        return f"{self.folder}/manifests/v{version:08d}.json"

    def versions(self) -> list[int]:
        """The committed versions whose manifests are there, in order."""
        at, fs = self._hadoop(f"{self.folder}/manifests")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)\.json", n)))

    def version(self) -> int:
        """The newest committed version, 0 for a new store."""
        return max(self.versions(), default=0)

    def _load(self, version: int) -> dict:
        at, fs = self._hadoop(self._file(version))
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _manifest(self, version: int | None = None) -> dict:
        """version, schema, shards and named arrivals of a version: the last snapshot up to it with the changes since."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": [], "arrivals": []}
        changes, at = [], version
        while "shards" not in (now := self._load(at)):
            changes.append(now)
            at -= 1
        held, arrivals = {s["path"]: s for s in now["shards"]}, list(now["arrivals"])
        for change in reversed(changes):
            for path in change["removed"]:
                del held[path]
            held |= {s["path"]: s for s in change["added"]}
            arrivals += change["arrivals"]
        return {"version": version, "schema": (changes or [now])[0]["schema"], "shards": list(held.values()), "arrivals": arrivals}

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**x) for x in self._manifest(version)["shards"]]

    def arrivals(self, version: int | None = None) -> list[str]:
        """The names of the arrivals of a version, as far as they have one."""
        return self._manifest(version)["arrivals"]

    def _commit(self, base: int, added: list[Shard], removed: list[str], schema: str, arrival: str | None = None) -> int:
        """Version base + 1 with these changes; raises Conflict if it exists."""
        named = [arrival] if arrival is not None else []
        body = {"version": base + 1, "schema": schema, "arrivals": named}
        if base % SNAPSHOT == 0:
            gone, before = set(removed), self._manifest(base)
            body["shards"] = [x for x in before["shards"] if x["path"] not in gone] + [asdict(s) for s in added]
            body["arrivals"] = before["arrivals"] + named
        else:
            body |= {"added": [asdict(s) for s in added], "removed": removed}
        draft, fs = self._hadoop(f"{self.folder}/manifests/.draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(body).encode()))
        stream.close()
        final = self._hadoop(self._file(base + 1))[0]
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, none)  # without OVERWRITE: fails if the version exists
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"version {base + 1} exists") from e
            raise
        return base + 1

    def _change(self, change: Callable[[dict], tuple | None]) -> int:
        """Commits what change makes of the newest manifest; again if another writer was first. The current version if it
        makes nothing."""
        while True:
            now = self._manifest()
            wanted = change(now)
            if wanted is None:
                return now["version"]
            try:
                return self._commit(now["version"], *wanted)
            except Conflict:
                continue

    # -- shards ---------------------------------------------------------------------------------------------------

    def _tier(self, size: int) -> int:
        """0 for shards of the target size or more; each further tier is smaller by the fanout."""
        return max(0, math.ceil(math.log(self.target / max(1, size), self.fanout)))

    def _written(self, folder: str, schema: T.StructType) -> list[Shard]:
        """The shards of a folder with their sizes and rows, from file metadata and Parquet footers."""
        read = self.spark.read.schema(schema).parquet(folder)
        rows = read.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).count().collect()
        return [Shard(r["path"], r["size"], r["count"], self._tier(r["size"])) for r in sorted(rows)]

    def _save(self, df: DataFrame) -> list[Shard]:
        folder = f"{self.folder}/shards/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(folder)
        return self._written(folder, df.schema)

    def append(self, rows: DataFrame, name: str | None = None) -> int:
        """Adds an arrival as small shards, in a new version; an arrival whose name the store has is in it already."""
        schema = rows.schema.json()

        def there(now: dict) -> bool:
            if now["schema"] is not None and T.StructType.fromJson(json.loads(now["schema"])).simpleString() != rows.schema.simpleString():
                raise ValueError("the arrival has other columns than the store")
            return name is not None and name in now["arrivals"]

        if there(now := self._manifest()):
            return now["version"]
        saved, late = self._save(rows), False

        def add(now: dict):
            nonlocal late
            late = there(now)
            return None if late else (saved, [], schema, name)

        version = self._change(add)
        if late:  # another writer was first with it
            self._delete(s.path for s in saved)
        return version

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs of similarly sized shards to merge, each of at most the target size.

        Tiers with `fanout` shards or more are packed; a run that doesn't reach the target is left for later arrivals
        unless it joins `fanout` shards.
        """
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.tier:
                tiers.setdefault(s.tier, []).append(s)
        runs = []
        for tier in sorted(tiers, reverse=True):
            if len(tiers[tier]) < self.fanout:
                continue
            run, held = [], 0
            for s in sorted(tiers[tier], key=lambda s: (s.bytes, s.path)):
                if run and held + s.bytes > self.target:
                    runs.append(run)
                    run, held = [], 0
                run.append(s)
                held += s.bytes
            if len(run) >= self.fanout:
                runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self) -> int:
        """Merges until no tier has a run to merge; one new version for each round. The current version if none."""
        while True:
            now = self._manifest()
            runs = self.plan([Shard(**x) for x in now["shards"]])
            if not runs:
                return now["version"]
            schema = T.StructType.fromJson(json.loads(now["schema"]))
            merged: list[Shard] = []
            for i in range(0, len(runs), MERGES_A_JOB):
                union = None
                for run in runs[i : i + MERGES_A_JOB]:
                    part = self.spark.read.schema(schema).parquet(*[s.path for s in run]).coalesce(1)
                    union = part if union is None else union.unionAll(part)
                merged += self._save(union)
            gone = [s.path for run in runs for s in run]

            void = False

            def replace(newest: dict, merged: list[Shard] = merged, gone: list[str] = gone):
                nonlocal void
                # Another writer may have merged some of them: then these merges are void.
                void = not set(gone) <= {x["path"] for x in newest["shards"]}
                return None if void else (merged, gone, newest["schema"])

            self._change(replace)
            if void:
                self._delete(s.path for s in merged)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        return self.located(version).select("row.*")

    def located(self, version: int | None = None) -> DataFrame:
        """(row, shard, shard_bytes): the rows of a version, all columns in one, with the name and size of their file."""
        now = self._manifest(version)
        if now["schema"] is None:
            raise ValueError(f"{self.folder} has no version yet")
        schema = T.StructType.fromJson(json.loads(now["schema"]))
        paths = [x["path"] for x in now["shards"]]
        row = F.struct(*[F.col(f"`{n}`") for n in schema.fieldNames()]).alias("row")
        if not paths:
            return self.spark.createDataFrame([], schema).select(row, F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"))
        name = F.concat_ws("/", F.element_at(F.split("_metadata.file_path", "/"), -2), "_metadata.file_name")
        return self.spark.read.schema(schema).parquet(*paths).select(row, name.alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"))

    def _delete(self, paths) -> None:
        for path in paths:
            at, fs = self._hadoop(path)
            fs.delete(at, False)

    def vacuum(self, keep: int = 1, age: float = 7 * 24 * 3600) -> int:
        """Deletes what only versions before the newest `keep` name, if the version after them is older than age seconds, so
        that readers of an older version may end; the number of shards deleted. Manifests stay from the snapshot that the
        oldest version kept builds on."""
        there, limit = self.versions(), time.time() - age
        # A version is out of date since the one after it was committed.
        old = [v for v, after in zip(there, there[1:], strict=False) if v in there[:-keep] and self._committed(after) <= limit]
        kept = [v for v in there if v not in old]
        held = {s.path for v in kept for s in self.shards(v)}
        gone = {s.path for v in old for s in self.shards(v)} - held
        self._delete(gone)
        base = kept[0] - (kept[0] - 1) % SNAPSHOT if kept else 0
        # The newest first: a version that still stands has all it builds on.
        self._delete(self._file(v) for v in reversed([v for v in old if v < base]))
        return len(gone)

    def _committed(self, version: int) -> float:
        at, fs = self._hadoop(self._file(version))
        return fs.getFileStatus(at).getModificationTime() / 1000


def shard(docs: DataFrame, target_bytes: int = TARGET_BYTES, folder: str | None = None, arrivals: int = ARRIVALS) -> DataFrame:
    """(doc_id, n_bytes, text_sha256, shard, shard_bytes) for each row of docs, read back from the newest version of the
    store in folder, to which docs come in several arrivals, with a compaction by tiers after each.

    A row's arrival follows from its doc_id and text, and arrivals have names: given the same docs, a lost run is
    completed by running it again, and a complete one adds nothing. All columns of docs are stored under their own names,
    whatever these are. Nulls stay null (n_bytes and text_sha256 too); repeated rows are stored each; an empty table
    makes versions without rows. Older versions stay; without a folder the store is a temporary one, deleted when the
    driver ends.
    """
    from ._common import new_path

    store = ShardStore(docs.sparkSession, folder or new_path(docs.sparkSession, "shards"), target_bytes)
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(arrivals))
    for i in range(arrivals):
        store.append(docs.where(turn == i), f"{i + 1} of {arrivals}")
        store.compact()
    return locations(store)


def locations(store: ShardStore) -> DataFrame:
    """(doc_id, n_bytes, text_sha256, shard, shard_bytes) of the newest version of a store of documents."""
    text = F.col("row.text").cast("string")
    return store.located().select(
        F.col("row.doc_id").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), "shard", "shard_bytes"
    )
