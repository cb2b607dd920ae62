"""A corpus that grows by whole archives, each recorded with what it holds and under which selection it was taken.

Rows go to a folder of their run first; then one log entry, written under a name of its own and renamed to the next
version without overwriting, makes its archives part of the corpus. Readers see the archives of log entries only, so
what a lost run wrote is never read, and of two writers of one version one fails and looks again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.hashing import part_sums


class Refused(ValueError):
    """The corpus can't take these archives; nothing of it was changed."""


class Conflict(RuntimeError):
    """Another writer made the version first."""


def rows_digest(*columns: str) -> Column:
    """An aggregate: the digest of a multiset of rows, whatever their order, from sums of eight parts of row hashes."""
    row = F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
    return F.sha2(F.concat_ws("|", F.count("*").cast("string"), *[p.cast("string") for p in part_sums(row)]), 256)


def selection_digest(selection: Mapping[str, object]) -> str:
    return hashlib.sha256(json.dumps(selection, sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class Entry:
    archive: str
    digest: str
    rows: int
    selection: str
    run: str


class Corpus:
    """``schema`` has the archive column; what it holds names an archive, of which there are few."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, archive: str = "archive"):
        self.spark, self.path, self.schema, self.archive = spark, path.rstrip("/"), schema, archive
        fs = spark._jvm.org.apache.hadoop.fs
        self.at = fs.Path
        self.fs = fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = fs.FileContext.getFileContext(self.fs.getUri(), spark._jsc.hadoopConfiguration())
        self.no_overwrite = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)

    def version(self) -> int:
        folder = self.at(f"{self.path}/log")
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return max((int(n[1:9]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def entries(self) -> dict[str, Entry]:
        if not (n := self.version()):
            return {}
        lines = self.spark.read.text([f"{self.path}/log/v{i:08d}.json" for i in range(1, n + 1)]).collect()
        return {e.archive: e for e in (Entry(**json.loads(x.value)) for x in lines if x.value)}

    def commit(self, base: int, new: list[Entry]) -> None:
        made, final = (self.at(f"{self.path}/log/{n}") for n in (f"_{uuid.uuid4().hex}", f"v{base + 1:08d}.json"))
        out = self.fs.create(made, False)
        out.write(bytearray("".join(json.dumps(asdict(e)) + "\n" for e in new).encode()))
        out.close()
        try:
            self.context.rename(made, final, self.no_overwrite)
        except Exception as e:
            self.fs.delete(made, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {base + 1} exists") from None
            raise

    def pending(self, found: dict[str, Entry], held: dict[str, Entry], selection: str) -> list[Entry]:
        """Which archives are new; refuses those under another selection or with other content than recorded."""
        if any(e.selection != selection for e in held.values()):
            raise Refused("the corpus was taken under a different selection")
        if changed := sorted(a for a in found if a in held and found[a].digest != held[a].digest):
            raise Refused(f"archives with other content than recorded: {', '.join(changed)}")
        return [e for a, e in sorted(found.items()) if a not in held]

    def append(self, rows: DataFrame, selection: Mapping[str, object], tries: int = 8) -> list[str]:
        """Add the archives of ``rows`` that are not recorded; returns their names. Doing it again adds nothing."""
        chosen, run = selection_digest(selection), uuid.uuid4().hex
        names = self.schema.names
        facts = rows.groupBy(F.col(self.archive).cast("string").alias("archive")).agg(F.count("*").alias("rows"), rows_digest(*names).alias("digest")).collect()
        if any(f.archive is None for f in facts):
            raise Refused("rows without an archive")
        found = {f.archive: Entry(f.archive, f.digest, f.rows, chosen, run) for f in facts}
        written: set[str] = set()
        for _ in range(tries):
            base = self.version()
            new = self.pending(found, self.entries(), chosen)
            if not new:
                return []
            if not written:
                some = rows.filter(F.col(self.archive).cast("string").isin([e.archive for e in new])).select(*names)
                some.write.option("compression", "zstd").partitionBy(self.archive).parquet(f"{self.path}/data/run={run}")
                written = {e.archive for e in new}
            elif written != {e.archive for e in new}:
                raise Conflict("another writer added some of these archives")
            try:
                self.commit(base, new)
                return [e.archive for e in new]
            except Conflict:
                continue
        raise Conflict(f"gave up after {tries} tries")

    def read(self) -> DataFrame:
        runs = sorted({e.run for e in self.entries().values()})
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        wide = T.StructType([*self.schema.fields, T.StructField("run", T.StringType())])
        found = self.spark.read.schema(wide).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/run={r}" for r in runs])
        return found.select(*self.schema.names)
