"""Sharding by size-tiered compaction (native: DataFrame reads and writes; the driver moves only small metadata).

A store is a folder of immutable runs and a series of manifests. Arrivals become small runs at once; runs of similar
size merge into one run of target-sized files; every change is a new manifest version, put in place as a whole by a step
that fails if the version exists, so writers that race start again from the newer one and readers never see half a change.
That step is a rename where the file system itself refuses to replace (HDFS); on local files, where Hadoop looks first and
renames then, and moves the checksum later, it is a hard link.
A merge deletes nothing: every version stays readable until ``vacuum`` retires it.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import file_system, new_path, table

FAN_IN = 4
TARGET_BYTES = 128 << 20
#: Runs up to this size are of the lowest tier.
BASE_BYTES = 1 << 20
#: Merges of different runs that one writer has under way at once.
MERGES = 4
#: The column that deals arrivals of one frame into folders; it is never stored in a file.
_DEAL = "__arrival"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    """Runs are folders of Parquet files below ``root``; a manifest lists the live ones with rows, bytes and tier."""

    def __init__(self, spark: SparkSession, root: str, fan_in: int = FAN_IN, target_bytes: int = TARGET_BYTES, base_bytes: int = BASE_BYTES):
        self.spark, self.root = spark, root.rstrip("/")
        self.fan_in, self.target_bytes, self.base_bytes = fan_in, target_bytes, base_bytes

    # manifests

    def versions(self) -> list[int]:
        fs, where = file_system(self.spark, f"{self.root}/manifests")
        if not fs.exists(where):
            return []
        return sorted(int(x.getPath().getName()[1:9]) for x in fs.listStatus(where) if x.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the latest by default; version 0 is the empty store."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return {"version": 0, "schema": None, "runs": []}
        fs, where = file_system(self.spark, self._at(version))
        with_bytes = fs.open(where)
        try:
            return json.loads(bytes(with_bytes.readAllBytes()))  # small: a line per live run
        finally:
            with_bytes.close()

    def _at(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:08d}.json"

    def commit(self, base: dict, runs: list[dict], schema: str | None = None) -> dict:
        """Puts the next version in place as a whole; Conflict if ``base`` is no longer the latest."""
        new = {"version": base["version"] + 1, "schema": schema or base["schema"], "runs": runs}
        jvm = self.spark._jvm
        fs, draft = file_system(self.spark, f"{self.root}/manifests/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        out.close()
        final = jvm.org.apache.hadoop.fs.Path(self._at(new["version"]))
        place = fs.resolvePath(draft)  # below mount tables
        try:
            if place.toUri().getScheme() == "file":
                names = [jvm.java.io.File(p).toPath() for p in (f"{place.getParent().toUri().getPath()}/{final.getName()}", place.toUri().getPath())]
                jvm.java.nio.file.Files.createLink(*names)
            else:
                option = jvm.org.apache.hadoop.fs.Options.Rename
                how = self.spark.sparkContext._gateway.new_array(option, 1)
                how[0] = option.NONE  # an existing version is never replaced
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(draft, final, how)
        except Exception as e:
            if fs.exists(final):
                raise Conflict(f"version {new['version']} exists") from e
            raise
        finally:
            fs.delete(draft, False)
        return new

    def _retried(self, change) -> dict:
        while True:
            base = self.manifest()
            try:
                return change(base)
            except Conflict:
                continue

    # runs

    def tier(self, size: int) -> int:
        return max(0, math.ceil(math.log(max(size, 1) / self.base_bytes, self.fan_in)))

    def _run(self, path: str, rows: int | None = None) -> dict:
        fs, where = file_system(self.spark, path)
        size = int(fs.getContentSummary(where).getLength())
        return {"path": path[len(self.root) + 1 :], "rows": self.spark.read.parquet(path).count() if rows is None else rows, "bytes": size, "tier": self.tier(size)}

    def _same_schema(self, base: dict, df: DataFrame) -> str:
        """The store's schema; an arrival has the same columns of the same types, whichever may be null."""
        bare = lambda kind: [(f.name, f.dataType.simpleString()) for f in kind.fields]
        if base["schema"] is None:
            return df.schema.json()
        if bare(held := StructType.fromJson(json.loads(base["schema"]))) != bare(df.schema):
            raise ValueError(f"the store holds {bare(held)}, this arrival has {bare(df.schema)}")
        return base["schema"]

    def append(self, df: DataFrame) -> dict:
        """One arrival becomes one run, as it is partitioned; an empty one commits no run. Another schema is an error."""
        self._same_schema(self.manifest(), df)
        path = f"{self.root}/runs/{uuid.uuid4().hex}"
        df.write.parquet(path)
        run = self._run(path)
        return self._retried(lambda base: self.commit(base, base["runs"] + [run] * (run["rows"] > 0), self._same_schema(base, df)))

    def append_many(self, df: DataFrame, arrival: Column) -> dict:
        """Arrivals that come in one frame: written in one pass, a run and a version each, in the order of ``arrival``.

        A null arrival comes first. Another schema than the store's is an error, and so is a column named __arrival.
        """
        if _DEAL in df.columns:
            raise ValueError(f"{_DEAL} is this store's own column")
        self._same_schema(self.manifest(), df)
        path = f"{self.root}/runs/{uuid.uuid4().hex}"
        df.withColumn(_DEAL, arrival.cast("int")).write.partitionBy(_DEAL).parquet(path)
        fs, where = file_system(self.spark, path)
        number = lambda name: int(name.partition("=")[2].replace("__HIVE_DEFAULT_PARTITION__", "-1"))
        found = sorted((x.getPath().getName() for x in fs.listStatus(where) if x.isDirectory()), key=number)
        out = self.manifest()
        if found:
            kind = StructType([*df.schema.fields, StructField(_DEAL, IntegerType())])
            rows = {r[0]: r[1] for r in self.spark.read.schema(kind).parquet(path).groupBy(_DEAL).count().collect()}  # a row per arrival
        for name in found:
            run = self._run(f"{path}/{name}", rows[None if name.endswith("__") else number(name)])
            out = self._retried(lambda base, run=run: self.commit(base, [*base["runs"], run], self._same_schema(base, df)))
        return out

    def _read(self, runs: list[dict], schema: str | None) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema)) if schema else StructType()
        if not runs:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/{r['path']}" for r in runs])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the latest by default; a version that ``vacuum`` has retired is an error."""
        if version and version not in self.versions():
            raise ValueError(f"there is no version {version}")
        m = self.manifest(version)
        return self._read(m["runs"], m["schema"])

    def due(self, runs: list[dict]) -> list[list[dict]]:
        """Groups of runs to merge next, none in two: in each tier, the smallest fan_in, the next fan_in, and so on."""
        out = []
        for tier in sorted({r["tier"] for r in runs}):
            same = sorted((r for r in runs if r["tier"] == tier), key=lambda r: (r["bytes"], r["path"]))
            out += [same[i : i + self.fan_in] for i in range(0, len(same) - self.fan_in + 1, self.fan_in)]
        return out

    def _merge(self, merging: list[dict], schema: str) -> dict | None:
        """Reads the runs' splits into target-sized files without a shuffle, and swaps them for the result; None if others took some."""
        path = f"{self.root}/runs/{uuid.uuid4().hex}"
        files = max(1, -(-sum(r["bytes"] for r in merging) // self.target_bytes))
        self._read(merging, schema).coalesce(files).write.parquet(path)
        run = self._run(path, sum(r["rows"] for r in merging))
        run["tier"] = max(run["tier"], merging[0]["tier"] + 1)  # runs that shrink in the merge still go up
        gone = {r["path"] for r in merging}

        def swap(base):
            if not gone <= {r["path"] for r in base["runs"]}:
                return None
            return self.commit(base, [r for r in base["runs"] if r["path"] not in gone] + [run])

        done = self._retried(swap)
        if done is None:
            fs, where = file_system(self.spark, path)
            fs.delete(where, True)
        return done

    def compact(self, keep: int | None = None) -> dict:
        """Merges until no tier has fan_in runs, MERGES at once. With ``keep``, all but so many versions are retired after each round."""
        while due := self.due((base := self.manifest())["runs"]):
            with ThreadPoolExecutor(MERGES) as pool:
                list(pool.map(lambda runs, schema=base["schema"]: self._merge(runs, schema), due))
            if keep is not None:
                self.vacuum(keep)
        return base

    def vacuum(self, keep: int = 1, older_than: float = 0.0) -> list[int]:
        """Retires versions that are neither among the last ``keep`` nor younger than ``older_than`` seconds, and deletes runs no other version lists.

        Readers of a retired version fail, so ``older_than`` should exceed the longest read. Runs that no manifest lists
        yet are a writer's and stay. Gives the versions retired.
        """
        fs, where = file_system(self.spark, f"{self.root}/manifests")
        if not fs.exists(where):
            return []
        since = {int(x.getPath().getName()[1:9]): x.getModificationTime() / 1000 for x in fs.listStatus(where) if x.getPath().getName().endswith(".json")}
        retired = [v for v in sorted(since)[: -max(1, keep)] if time.time() - since[v] >= older_than]
        runs = lambda versions: {r["path"] for v in versions for r in self.manifest(v)["runs"]}
        dead = runs(retired) - runs(set(since) - set(retired)) if retired else set()
        for v in retired:  # manifests go first, so none lists a run that is gone
            fs.delete(file_system(self.spark, self._at(v))[1], False)
        for path in dead:
            fs.delete(file_system(self.spark, f"{self.root}/{path}")[1], True)
        return retired


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in 16 batches, are compacted, and are read back through the last manifest.

    A row per stored document: doc_id, lang, source, n_chars and the text's SHA-256, null for a null text. Batches that
    get no rows make no run, repeats are stored each, and other columns are kept in the store. Nobody else reads this
    store, so versions retire as soon as the next one stands.
    """
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, new_path(spark, "shards"))
    store.append_many(docs, F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    store.compact(keep=1)
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


OP4_SQL = "select doc_id, lang, source, n_chars, sha256(text) as text_sha256 from documents"
