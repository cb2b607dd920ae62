"""Size-tiered compaction of arriving shards under a versioned manifest.

A store is a folder of immutable shards (``shards/<id>``, Parquet) and of manifests (``manifest/v00000001.json`` and so
on), each a list of the live shards with their rows, bytes and files. Arrivals are appended as small shards. A
compaction takes the shards whose files are under half of the target size (an arrival of any size comes in as many
files as tasks wrote it), puts sizes within a factor of ``fanout`` in one tier, and merges each tier with at least
``fanout`` shards into files of the target size, sorted by key, as it does a shard over the target with ``fanout`` times
the files it needs; it repeats until there are none. Every change writes new shards first and then one new manifest: the manifest is written under a
name of its own and renamed, which fails if the version is there already, so of two writers one wins and the other
can try again. Readers see whole versions only; files of no version are garbage and harm nothing.

Files go through Spark's writers and Hadoop's file system, so any store that Spark writes to will do, and a lost
executor costs a rerun of its tasks. A manifest has a line for each shard, never for a row.

Defined cases: any column may be null; rows are moved as they are, repeats and very long texts included; a null key
sorts first; rows with a null arrival are an arrival of their own; columns may have any name; an arrival without rows adds no shard; an empty store reads as no rows of the schema given. All columns are kept.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.shared import shared_path

ARRIVALS = 20


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Shard:
    id: str
    rows: int
    bytes: int
    files: int


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, *, target_bytes: int = 128 << 20, fanout: int = 4, smallest: int = 1 << 16):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.target, self.fanout, self.smallest = target_bytes, fanout, smallest
        jvm = spark._jvm.org.apache.hadoop.fs
        self.to_path = jvm.Path
        self.fs = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = jvm.FileContext.getFileContext(self.fs.getUri(), spark._jsc.hadoopConfiguration())
        self.no_overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    # manifests

    def version(self) -> int:
        folder = self.to_path(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return max((int(n[1:9]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if version == 0:
            return []
        lines = self.spark.read.text(f"{self.path}/manifest/v{version:08d}.json").collect()
        return [Shard(**json.loads(x.value)) for x in lines if x.value]

    def commit(self, base: int, live: list[Shard]) -> int:
        """Make ``live`` version ``base + 1``, or raise Conflict if that exists."""
        made, final = (self.to_path(f"{self.path}/manifest/{n}") for n in (f"_{uuid.uuid4().hex}", f"v{base + 1:08d}.json"))
        out = self.fs.create(made, False)
        out.write(bytearray("".join(json.dumps(asdict(s)) + "\n" for s in live).encode()))
        out.close()
        try:
            self.context.rename(made, final, self.no_overwrite)
        except Exception as e:
            self.fs.delete(made, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {base + 1} exists") from None
            raise
        return base + 1

    def change(self, make, tries: int = 8) -> int:
        """Commit ``make(live shards)``; after a conflict, on top of what came in between."""
        for _ in range(tries):
            base = self.version()
            try:
                return self.commit(base, make(self.shards(base)))
            except Conflict:
                continue
        raise Conflict(f"gave up after {tries} tries")

    # shards

    def location(self, shard: Shard | str) -> str:
        return f"{self.path}/shards/{shard if isinstance(shard, str) else shard.id}"

    def written(self, ids: list[str]) -> list[Shard]:
        """Shards as they are on disk; rows are counted from the files' footers."""
        if not ids:
            return []
        counted = self.spark.read.schema(self.schema).parquet(*map(self.location, ids)).groupBy(F.regexp_extract(F.col("_metadata.file_path"), r"/shards/([^/]+)/", 1).alias("id")).agg(F.count("*").alias("rows")).collect()
        rows = {r["id"]: r["rows"] for r in counted}
        sizes = {i: [s.getLen() for s in self.fs.listStatus(self.to_path(self.location(i))) if s.getPath().getName().startswith("part-")] for i in rows}
        return [Shard(i, rows[i], sum(sizes[i]), len(sizes[i])) for i in sorted(rows)]

    def append(self, arrivals: DataFrame, arrival: Column | None = None) -> int:
        """Add each arrival (rows with one value of ``arrival``; all rows, without it) as a shard of its own."""
        batch = uuid.uuid4().hex
        if arrival is None:
            arrivals.select(*self.schema.names).write.option("compression", "zstd").parquet(self.location(f"{batch}-0"))
            ids = [f"{batch}-0"]
        else:
            # one job: a folder for each arrival, written by as few tasks as a hash of arrival and a small salt deals it to
            column = "arrival"
            while column in self.schema.names:
                column += "_"
            name = F.coalesce(F.concat(F.lit("v"), F.md5(arrival.cast("string"))), F.lit("none"))  # any value, null too, names a folder
            apart = arrivals.select(*self.schema.names, name.alias(column))
            apart.write.partitionBy(column).option("compression", "zstd").parquet(f"{self.path}/incoming/{batch}")
            self.fs.mkdirs(self.to_path(f"{self.path}/shards"))
            made = sorted(s.getPath().getName() for s in self.fs.listStatus(self.to_path(f"{self.path}/incoming/{batch}")) if s.isDirectory())
            ids = [f"{batch}-{i}" for i in range(len(made))]
            for folder, i in zip(made, ids):  # fails where the name is taken, so no committed shard is ever touched
                self.context.rename(self.to_path(f"{self.path}/incoming/{batch}/{folder}"), self.to_path(self.location(i)), self.no_overwrite)
        new = self.written(ids)
        return self.change(lambda live: live + new)

    def tier(self, shard: Shard) -> int:
        return int(math.log(max(1.0, shard.bytes / self.smallest), self.fanout))

    def small(self, shard: Shard) -> bool:
        """Whether its files are small, however many and whatever they hold in all."""
        return shard.bytes / max(1, shard.files) < self.target / 2

    def scattered(self, shard: Shard) -> bool:
        """Whether it has ``fanout`` times the files it needs or more: it is merged by itself."""
        return shard.files >= self.fanout * max(1, math.ceil(shard.bytes / self.target))

    def full_tiers(self, live: list[Shard]) -> list[list[Shard]]:
        tiers: dict[int, list[Shard]] = {}
        for s in filter(self.small, live):
            tiers.setdefault(self.tier(s), []).append(s)
        full = {i for i, t in tiers.items() if len(t) >= self.fanout}
        alone = [[s] for i, t in sorted(tiers.items()) if i not in full for s in t if s.bytes >= self.target and self.scattered(s)]
        return [tiers[i] for i in sorted(full)] + alone

    def merge(self, group: list[Shard]) -> list[Shard]:
        files = max(1, math.ceil(sum(s.bytes for s in group) / self.target))
        rows = self.spark.read.schema(self.schema).parquet(*map(self.location, group))
        made = uuid.uuid4().hex
        # so no file holds more than about the target, and a drawn number parts the rows of a key that is frequent
        drawn = "drawn"
        while drawn in self.schema.names:
            drawn += "_"
        sort = [F.col(f"`{self.key}`").asc_nulls_first(), F.col(drawn)]
        rows.withColumn(drawn, F.rand(7)).repartitionByRange(files, *sort).sortWithinPartitions(*sort).drop(drawn).write.option("compression", "zstd").parquet(self.location(made))
        return self.written([made])

    def compact(self, whole: bool = False) -> int:
        """Merge full tiers until none is; ``whole``: then all that is still small into one run."""
        last = False
        while True:
            live = self.shards()
            groups = self.full_tiers(live)
            if not groups and whole and not last:
                rest, last = [s for s in live if self.small(s)], True
                groups = [rest] if sum(max(1, s.files) for s in rest) > max(1, math.ceil(sum(s.bytes for s in rest) / self.target)) else []
            if not groups:
                return self.version()
            done = [(g, self.merge(g)) for g in groups]

            def swap(now: list[Shard], done=done) -> list[Shard]:
                gone = {s.id for g, _ in done for s in g}
                if not gone <= {s.id for s in now}:
                    raise RuntimeError("merged shards were taken away by another writer")
                return [s for s in now if s.id not in gone] + [s for _, new in done for s in new]

            self.change(swap)

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete shards that none of the last versions names, and older manifests."""
        newest = self.version()
        used = {s.id for v in range(max(1, newest - keep_versions + 1), newest + 1) for s in self.shards(v)}
        folder, gone = self.to_path(f"{self.path}/shards"), 0
        for s in self.fs.listStatus(folder) if self.fs.exists(folder) else []:
            if s.getPath().getName() not in used:
                self.fs.delete(s.getPath(), True)
                gone += 1
        for v in range(1, newest - keep_versions + 1):
            self.fs.delete(self.to_path(f"{self.path}/manifest/v{v:08d}.json"), False)
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        live = self.shards(version)
        if not live:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*map(self.location, live))


def op6_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in 20 batches of sizes from small to large, are compacted, and are read by the last manifest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = Store(spark, shared_path(spark, "store"), docs.schema, "doc_id")
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS * ARRIVALS))
    store.append(docs, F.floor(F.sqrt(spread)).cast("int"))
    store.compact(whole=True)
    store.vacuum()
    return store.read().select("doc_id", "source", "lang", F.char_length("text").cast("long").alias("text_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


OP6_SQL = "SELECT doc_id, source, lang, length(text)::BIGINT AS text_chars, sha256(text) AS text_sha256 FROM documents"
