"""Sharding by size-tiered compaction.

`ShardStore.append` writes arrivals as small immutable Parquet shards. `compact` puts shards into tiers by size (a tier is a power of
`fanout`), packs the runs of a tier that has `fanout` of them, in order, into groups of the target size, and merges all groups of all
tiers in one job, a task each; files of the target size are left alone.

Each change is one new version of the manifest: a segment file that names the shards added and removed, and a small version file that
lists segments, made by an atomic rename that fails if the version exists. So a commit costs as much as it changes (now and then the
segments are folded into one), and readers see the old or the new set of shards, never a mixture. A commit that loses to another
writer's is made again on top of it: arrivals always, a merge if all it replaces is still there, else it is planned anew. A job that
dies leaves only files that no version names. Shards that a version has replaced stay for the readers of older versions until `vacuum`,
which keeps the last versions and what they name.

No shuffle: appended files follow the input's partitions, a merge reads its group's files. Rows keep all columns, nulls and order
within a shard; a column that a shard lacks is null. An empty arrival adds no shard and no version.
"""

from __future__ import annotations

import json
import math
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, scratch, store, table

TARGET_BYTES, FANOUT, ARRIVAL_ROWS, SEGMENTS, KEEP = 128 << 20, 4, 2000, 32, 2


class Conflict(RuntimeError):
    """Another writer has taken the version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        jvm = spark.sparkContext._jvm
        self.path, self.options = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Options
        configuration = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(self.root).getFileSystem(configuration)
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(self.root).toUri(), configuration)
        self.segments: dict[str, dict] = {}  # segment files never change
        for name in ("manifests", "segments", "data"):
            self.fs.mkdirs(self.path(f"{self.root}/{name}"))

    # -- files of the manifest

    def _read(self, name: str) -> dict:
        stream = self.fs.open(self.path(f"{self.root}/{name}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write_json(self, name: str, value: dict) -> None:
        out = self.fs.create(self.path(f"{self.root}/{name}"), False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _segment(self, add: list[dict], remove: list[str]) -> str:
        name = uuid.uuid4().hex
        self._write_json(f"segments/{name}.json", {"add": add, "remove": remove})
        return name

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(f"{self.root}/manifests"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, segments, shards: [{path, bytes, rows, tier}]} of the version given or the latest; version 0 is empty."""
        found = self.versions() if version is None else []
        version = (found[-1] if found else 0) if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "segments": [], "shards": []}
        head, shards = self._read(f"manifests/{version:08d}.json"), {}
        for name in head["segments"]:
            part = self.segments.setdefault(name, None) or self._read(f"segments/{name}.json")
            self.segments[name] = part
            for path in part["remove"]:
                shards.pop(path, None)
            shards |= {s["path"]: s for s in part["add"]}
        return head | {"shards": list(shards.values())}

    def commit(self, base: dict, schema: str, add: list[dict], remove: tuple[str, ...] = ()) -> dict:
        """The next version after `base`; raises Conflict if another writer has taken it."""
        gone = set(remove)
        shards = [s for s in base["shards"] if s["path"] not in gone] + add
        folded = len(base["segments"]) >= SEGMENTS
        segments = [self._segment(shards, [])] if folded else [*base["segments"], self._segment(add, sorted(gone))]
        new = {"version": base["version"] + 1, "schema": schema, "segments": segments}
        draft = f"manifests/_{uuid.uuid4().hex}"
        self._write_json(draft, new)
        none = self.spark.sparkContext._gateway.new_array(self.options.Rename, 1)
        none[0] = self.options.Rename.NONE
        from py4j.protocol import Py4JJavaError

        try:
            self.context.rename(self.path(f"{self.root}/{draft}"), self.path(f"{self.root}/manifests/{new['version']:08d}.json"), none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            self.fs.delete(self.path(f"{self.root}/{draft}"), False)
            raise Conflict(f"version {new['version']} exists") from e
        return new | {"shards": shards}

    # -- shards

    def tier(self, size: int) -> int:
        """0: target size reached; n: at least target / fanout ** n."""
        return max(0, math.ceil(math.log(self.target * 0.75 / max(1, size), self.fanout)))

    def _write(self, df: DataFrame, rows_per_file: int) -> list[dict]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(folder)
        sizes = {s.getPath().toString(): s.getLen() for s in self.fs.listStatus(self.path(folder)) if s.getPath().getName().startswith("part-")}
        if not sizes:
            return []
        counted = self.spark.read.schema(df.schema).parquet(folder).groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name")).count().collect()  # a row per file just written
        rows = {r["name"]: r["count"] for r in counted}
        named = [(p, b, rows.get(p.rsplit("/", 1)[1], 0)) for p, b in sorted(sizes.items())]
        return [{"path": p, "bytes": b, "rows": n, "tier": self.tier(b)} for p, b, n in named if n]

    def append(self, df: DataFrame, rows_per_file: int = ARRIVAL_ROWS) -> dict:
        shards = self._write(df, rows_per_file)
        while shards:
            try:
                return self.commit(self.manifest(), df.schema.json(), shards)
            except Conflict:  # another writer's version comes first
                continue
        return self.manifest()

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Groups of similarly sized runs to merge, each of about the target size at most."""
        groups = []
        for tier in sorted({s["tier"] for s in shards if s["tier"] > 0}, reverse=True):
            runs = [s for s in shards if s["tier"] == tier]
            if len(runs) < self.fanout:
                continue
            group, size = [], 0
            for s in runs:
                if group and size + s["bytes"] > self.target:
                    groups.append(group)
                    group, size = [], 0
                group.append(s)
                size += s["bytes"]
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def _merge(self, groups: list[list[dict]], schema: str) -> list[dict]:
        """One job: each task streams the shards of its group into one file."""
        bounded_batches(self.spark)
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        self.fs.mkdirs(self.path(folder))

        def merged(batches):
            from pyspark.sql.pandas.types import to_arrow_schema

            kind = to_arrow_schema(StructType.fromJson(json.loads(schema)))
            for batch in batches:
                for paths in batch.column("paths").to_pylist():
                    path = f"{folder}/part-{uuid.uuid4().hex}.parquet"
                    yield pa.RecordBatch.from_pylist([{"path": path} | stream_into(paths, path, kind)])

        asked = self.spark.createDataFrame([(i, [s["path"] for s in g]) for i, g in enumerate(groups)], "i int, paths array<string>")
        found = asked.repartitionByRange(len(groups), "i").mapInArrow(merged, "path string, bytes long, rows long").collect()  # a row per file just written
        return [{"path": r["path"], "bytes": r["bytes"], "rows": r["rows"], "tier": self.tier(r["bytes"])} for r in sorted(found, key=lambda r: r["path"])]

    def compact(self, keep: int | None = None) -> dict:
        """Merges until no tier has `fanout` runs. keep: vacuums after each version but the last so many; None: nothing is removed."""
        now = self.manifest()
        while groups := self.plan(now["shards"]):
            old = [s for g in groups for s in g]
            new = self._merge(groups, now["schema"])
            if sum(s["rows"] for s in new) != sum(s["rows"] for s in old):
                raise RuntimeError("a merge changed the number of rows")
            gone = tuple(s["path"] for s in old)
            while True:
                try:
                    now = self.commit(now, now["schema"], new, gone)
                    break
                except Conflict:
                    now = self.manifest()
                    if not {s["path"] for s in now["shards"]}.issuperset(gone):  # another compaction took some: plan anew
                        for s in new:
                            self.fs.delete(self.path(s["path"]), False)
                        break
            if keep is not None:
                self.vacuum(keep)
        return now

    def vacuum(self, keep: int = KEEP) -> int:
        """Removes all versions but the last `keep`, and the shards and segments that only removed versions name. Returns the number of shards."""
        versions = self.versions()
        held = [self.manifest(v) for v in versions[-keep:]]
        older = [self.manifest(v) for v in versions[:-keep]]
        shards, segments = {s["path"] for m in held for s in m["shards"]}, {s for m in held for s in m["segments"]}
        gone = {s["path"] for m in older for s in m["shards"]} - shards
        for m in older:
            self.fs.delete(self.path(f"{self.root}/manifests/{m['version']:08d}.json"), False)
        for name in {s for m in older for s in m["segments"]} - segments:
            self.fs.delete(self.path(f"{self.root}/segments/{name}.json"), False)
        for path in gone:
            self.fs.delete(self.path(path), False)
        return len(gone)

    def read(self, version: int | None = None) -> DataFrame | None:
        now = self.manifest(version)
        if not now["shards"]:
            return None
        return self.spark.read.schema(StructType.fromJson(json.loads(now["schema"]))).parquet(*[s["path"] for s in now["shards"]])


def stream_into(paths: list[str], path: str, kind: pa.Schema) -> dict:
    """Copies Parquet files, in order, into one of the given schema."""
    import pyarrow.parquet as pq

    files, at = store(path)
    rows = 0
    with files.open_output_stream(at) as out, pq.ParquetWriter(out, kind, compression="snappy") as writer:
        for source in paths:
            with files.open_input_file(store(source)[1]) as stream:
                for batch in pq.ParquetFile(stream).iter_batches(4096):
                    columns = [batch.column(f.name).cast(f.type) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in kind]
                    writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=kind))
                    rows += batch.num_rows
    return {"bytes": files.get_file_info(at).size, "rows": rows}


def query(spark, sf_dir: str) -> DataFrame:
    """Appends all documents as arrivals, compacts, and reads every row back with the shard that holds it."""
    docs = table(spark, sf_dir, "documents")
    shards = ShardStore(spark, scratch(spark, "shards"), target_bytes=TARGET_BYTES)
    shards.append(docs)
    now = shards.compact(keep=KEEP)
    rows = shards.read()
    if rows is None:
        return docs.select("doc_id", F.lit(None).cast("string").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("version"), F.xxhash64("text").alias("text_hash"))
    return rows.select("doc_id", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"), F.lit(now["version"]).cast("long").alias("version"), F.xxhash64("text").alias("text_hash"))
