"""A table of immutable shards with size-tiered compaction and versioned manifests.

`append` writes arrivals as small Parquet shards, one for each partition of
the input. Tiers are ranges of size, each FAN times the one before. `compact`
merges shards of one tier as soon as there are FAN of them, in runs up to
TARGET_BYTES, oldest first; what they give belongs to a higher tier, where it
waits for others of its size, so that a row is rewritten once a tier at most
and small arrivals never drag large shards along. Each round of merges, from the
smallest tier up, is a version of its own. Shards of half the target and more
are full and are left alone. A merge reads its shards into one task and writes
one file, without a shuffle.

A version is a manifest, the list of live shards, written aside and renamed to
the next version's name, which fails if another writer has taken it; then the
change is made anew on the version that won, or given up if a shard that was
merged is gone. Readers follow one manifest, so they see all of a version or
none of it; old shards stay until `vacuum`.

DataFrame functions only; Python on the driver handles the manifest, a row a
shard.

Cases: rows are stored as they are, nulls, repeated rows and all columns
included; an empty table gives a version without shards and reads as no rows;
shards of equal age are merged in the order of their names; fewer than FAN
shards of a tier are left as they are.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES = 128 << 20
#: Shards below this are of tier 0.
SMALL_BYTES = 1 << 18
FAN = 4
#: Attempts at a commit that other writers come before.
TRIES = 20
#: Merges in one Spark job.
WAVE = 64


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int
    tier: int
    #: The version that added it.
    since: int = 0


class LostCommit(Exception):
    """Another writer has taken the version."""


def tier_of(size: int, small: int = SMALL_BYTES, fan: int = FAN) -> int:
    tier = 0
    while size >= small:
        small *= fan
        tier += 1
    return tier


class ShardTable:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET_BYTES):
        self.spark, self.path, self.target = spark, path.rstrip("/"), target
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        # Else a union of single partitions is a single partition; set in a session of its own, so no other job sees it.
        self._merging = spark.newSession()
        self._merging.conf.set("spark.sql.unionOutputPartitioning", "false")

    # Files

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self._conf)

    def _list(self, path: str) -> list[tuple[str, int]]:
        at, fs = self._at(path)
        if not fs.exists(at):
            return []
        return sorted((s.getPath().toString(), s.getLen()) for s in fs.listStatus(at) if s.isFile())

    def _read_text(self, path: str) -> str:
        at, fs = self._at(path)
        stream = fs.open(at)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    # Manifests

    def _versions(self) -> list[int]:
        names = [p.rpartition("/")[2] for p, _ in self._list(f"{self.path}/_manifest")]
        return [int(n[1:-5]) for n in names if n[0] == "v" and n.endswith(".json")]

    def version(self) -> int:
        """The latest version; 0 before the first commit."""
        return max([0, *self._versions()])

    def manifest(self, version: int | None = None) -> tuple[list[Shard], str | None]:
        """The shards of a version, and the schema of their rows."""
        version = self.version() if version is None else version
        if not version:
            return [], None
        got = json.loads(self._read_text(f"{self.path}/_manifest/v{version:08d}.json"))
        return [Shard(**x) for x in got["shards"]], got["schema"]

    def _commit(self, version: int, shards: list[Shard], schema: str) -> None:
        """Make this the version, or raise LostCommit."""
        final, fs = self._at(f"{self.path}/_manifest/v{version:08d}.json")
        aside, _ = self._at(f"{self.path}/_manifest/.{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]}).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        plain[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(aside, final, plain)
        except Exception:
            fs.delete(aside, False)
            if fs.exists(final):
                raise LostCommit(f"version {version} exists") from None
            raise

    def _change(self, gone: list[Shard], added: list[Shard], schema: str) -> int | None:
        """Commit a version without the shards that are gone and with those added, after whatever others commit meanwhile; None if others took away what is to go."""
        for _ in range(TRIES):
            version = self.version()
            live, known = self.manifest(version)
            paths = {s.path for s in gone}
            if not paths <= {s.path for s in live}:
                return None
            stay = [s for s in live if s.path not in paths]
            try:
                self._commit(version + 1, stay + [replace(s, since=version + 1) for s in added], known or schema)
                return version + 1
            except LostCommit:
                continue
        raise LostCommit(f"{TRIES} versions were taken by others")

    # Writing

    def _written(self, df: DataFrame) -> list[tuple[int, str, int]]:
        """Write df to a folder of its own: (partition, path, bytes) of each file."""
        out = f"{self.path}/shards/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(out)
        files = [(p, n) for p, n in self._list(out) if "/part-" in p]
        return [(int(p.rpartition("/part-")[2][:5]), p, n) for p, n in files]

    def append(self, rows: DataFrame) -> int:
        """Add rows as small shards, one for each partition; the new version."""
        files = self._written(rows)
        counts = {}
        if files:
            seen = self.spark.read.schema(rows.schema).parquet(*[p for _, p, _ in files])
            counts = {r["name"]: r["n"] for r in seen.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n")).collect()}
        added = [Shard(p, n, counts[p.rpartition("/")[2]], tier_of(n)) for _, p, n in files if counts.get(p.rpartition("/")[2])]
        return self._change([], added, rows.schema.json())

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """The next round of merges: runs of FAN shards and more, up to the target, within the smallest tier that has so many."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target // 2:
                tiers.setdefault(s.tier, []).append(s)
        for tier in sorted(t for t, own in tiers.items() if len(own) >= FAN):
            runs: list[list[Shard]] = []
            size = 0
            for s in sorted(tiers[tier], key=lambda s: (s.since, s.path)):
                # A full run ends at the target; from there on the next FAN shards make the next.
                if not runs or (len(runs[-1]) >= 2 and size + s.bytes > self.target):
                    runs.append([])
                    size = 0
                runs[-1].append(s)
                size += s.bytes
            if len(runs) > 1 and len(runs[-1]) < FAN:
                runs.pop()
            return runs
        return []

    def compact(self) -> int:
        """Rounds of merges until no tier has FAN shards, each a version; the latest version."""
        from pyspark.sql import types as T

        while True:
            version = self.version()
            live, schema = self.manifest(version)
            runs = self.plan(live)
            if not runs:
                return version
            kind = T.StructType.fromJson(json.loads(schema))
            merged: list[Shard] = []
            for i in range(0, len(runs), WAVE):
                wave = runs[i : i + WAVE]
                # One job, a task and a file for each run.
                parts = [self._merging.read.schema(kind).parquet(*[s.path for s in run]).coalesce(1) for run in wave]
                files = self._written(reduce(DataFrame.union, parts))
                if len(files) != len(wave):
                    raise RuntimeError(f"{len(wave)} merges gave {len(files)} files")
                merged += [Shard(p, n, sum(s.rows for s in wave[k]), max(tier_of(n), 1 + wave[k][0].tier)) for k, p, n in files]
            if self._change([s for run in runs for s in run], merged, schema) is None:
                # Another writer has merged some of these meanwhile: its version holds all rows, and ours is given up.
                for s in merged:
                    self._delete(s.path)

    def _delete(self, path: str) -> bool:
        at, fs = self._at(path)
        return bool(fs.delete(at, False))

    def vacuum(self) -> int:
        """Delete older manifests, and shards that they list and the latest version doesn't; how many files went. What others have written and not committed yet stays."""
        version = self.version()
        live = {s.path for s in self.manifest(version)[0]}
        old = [k for k in self._versions() if k < version]
        gone = {s.path for k in old for s in self.manifest(k)[0]} - live
        return sum(map(self._delete, [*sorted(gone), *(f"{self.path}/_manifest/v{k:08d}.json" for k in old)]))

    # Reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with `_shard`, the number of the row's shard in the manifest, and `_tier`."""
        from pyspark.sql import types as T

        shards, schema = self.manifest(version)
        kind = T.StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind).select("*", F.lit(0).alias("_shard"), F.lit(0).alias("_tier"))
        index = self.spark.createDataFrame([(s.path.rpartition("/")[2], k, s.tier) for k, s in enumerate(shards)], "_name string, _shard int, _tier int")
        rows = self.spark.read.schema(kind).parquet(*[s.path for s in shards]).select("*", F.col("_metadata.file_name").alias("_name"))
        # A row a shard: bounded by the table's size over the target, some hundred KB for each 100 GB.
        return rows.join(F.broadcast(index), "_name").drop("_name")
