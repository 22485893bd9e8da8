"""A table by key in the shared folder: writes rewrite the buckets they touch, and a snapshot is swapped in one step."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plotlens.session import drop_staged, staged

#: Buckets of a new table: choose so that one holds about a GB; ``rebucket`` changes the number later.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has published the next snapshot first: nothing of this write shows; run it again."""


class KeyedTable:
    """One row for each key, in buckets by the hash of ``by`` (the keys, or some of them).

    A write puts whole new versions of the touched buckets beside the old ones and then publishes a
    manifest that names the folder of each bucket. Readers see the last manifest, so a writer that is
    killed half-way leaves the old snapshot; of two writers at once the later one gets ``Conflict``.
    A write may carry ``run=(writer, number)``: the manifest keeps the last number of each writer, and
    a run that it holds already changes nothing, which makes ``foreachBatch`` writes exactly-once.

    Rows with a null in the key are not stored and counted as ``incomplete``. Of rows of a batch with
    one key the newest by ``at`` counts, then the greatest by value, so values must be comparable (no
    maps). A column that a batch lacks keeps its value; one that the table lacks is added, null in the
    rows before. Columns may have any name. A table that was never written cannot be read; an empty
    batch writes an empty table. Moving the manifest must be atomic and must not overwrite: HDFS is so.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS, by: list[str] | None = None):
        self.spark, self.path, self.keys, self.by, self.buckets = spark, path.rstrip("/"), keys, by or keys, buckets

    # Snapshots

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json"))

    def snapshot(self, version: int | None = None) -> dict | None:
        """The manifest of a version, of the last one if none is named; null if nothing was written."""
        known = self.versions()
        if not known:
            return None
        path = self._path(f"manifests/{version or known[-1]:010d}.json")
        stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a snapshot, of all buckets or of those named."""
        held = self.snapshot(version)
        if held is None:
            raise FileNotFoundError(f"no snapshot at {self.path}")
        return self._rows(held, buckets)

    def bucket(self) -> Column:
        """The bucket of a row that has the columns ``by``."""
        held = self.snapshot()
        return self._bucket(held["buckets"] if held else self.buckets)

    # Writes

    def upsert(self, batch: DataFrame, at: str | None = None, keep_known: bool = False, sums: Iterable[str] = (), run: tuple[str, int] | None = None) -> dict:
        """Insert or replace by key; with ``keep_known`` a null keeps the value there was, columns of ``sums`` are added up.

        Returns the snapshot's ``version`` and how many rows were ``inserted``, ``updated`` and ``incomplete``.
        """
        held = self.snapshot()
        if self._has_run(held, run):
            return {"version": held["version"], "inserted": 0, "updated": 0, "incomplete": 0}
        sums = set(sums)
        buckets, schema = held["buckets"] if held else self.buckets, self._schema(held, batch)
        new, incomplete = self._reduced(batch, schema, buckets, at, keep_known, sums)
        touched = [r[0] for r in new.select("bucket").distinct().collect()]
        given = set(batch.columns)

        def pick(c: str) -> Column:
            a, b = F.col("a").getField(c), F.col("b").getField(c)
            if c not in given:
                return a
            if c in sums:
                return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
            return F.coalesce(b, a) if keep_known else F.when(F.col("b").isNotNull(), b).otherwise(a)

        both = self._met(held, schema, buckets, new, touched)
        counts = {"inserted": F.count_if(F.col("a").isNull()), "updated": F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())}
        out = self._write(both, counts, F.lit(True), pick, held, schema, buckets, touched, run)
        drop_staged(new)
        return out | {"incomplete": incomplete}

    def rebuild(self, rows: DataFrame, stamp: str, since: Column, verdict: str | None = None, run: tuple[str, int] | None = None) -> dict:
        """Upsert ``rows`` and remove the others whose ``stamp`` is older than ``since``, in one snapshot.

        Rows without a stamp or of a later run stay. With ``verdict``, what that column holds survives, and a row that
        holds something is never removed. Returns the counts of ``upsert`` and how many rows were ``removed``.
        """
        held = self.snapshot()
        if self._has_run(held, run):
            return {"version": held["version"], "inserted": 0, "updated": 0, "removed": 0, "incomplete": 0}
        buckets, schema = held["buckets"] if held else self.buckets, self._schema(held, rows)
        new, incomplete = self._reduced(rows, schema, buckets, None, False, set())
        a, b, given = F.col("a"), F.col("b"), set(rows.columns)
        stale = b.isNull() & F.coalesce(a.getField(stamp) < since, F.lit(False))
        if verdict:
            stale = stale & a.getField(verdict).isNull()

        def pick(c: str) -> Column:
            if c == verdict:
                return F.coalesce(a.getField(c), b.getField(c))
            return F.when(b.isNotNull(), b.getField(c)).otherwise(a.getField(c)) if c in given else a.getField(c)

        counts = {"inserted": F.count_if(a.isNull()), "updated": F.count_if(a.isNotNull() & b.isNotNull()), "removed": F.count_if(stale)}
        every = list(range(buckets))
        out = self._write(self._met(held, schema, buckets, new, every), counts, ~stale, pick, held, schema, buckets, every, run)
        drop_staged(new)
        return out | {"incomplete": incomplete}

    def rebucket(self, buckets: int) -> dict:
        """Deal all rows into another number of buckets."""
        held = self.snapshot()
        schema = StructType.fromJson(held["schema"])
        rows = self._rows(held).select(self._bucket(buckets).alias("bucket"), self._key().alias("key"), self._row(schema).alias("a"), F.lit(None).alias("b"))
        return self._write(rows.repartition(buckets, "bucket"), {"moved": F.count("*")}, F.lit(True), lambda c: F.col("a").getField(c), held | {"folders": {}}, schema, buckets, list(range(buckets)), None)

    def vacuum(self, keep: int = 2, hours: float = 24) -> None:
        """Delete all snapshots but the last ``keep``, and folders that none of these names and that are older than ``hours``.

        A running write or reader needs fewer hours than that.
        """
        known = self.versions()
        for version in known[:-keep]:
            self._delete(f"manifests/{version:010d}.json")
        used = {folder for version in known[-keep:] for folder in self.snapshot(version)["folders"].values()}
        for name, changed in self._listed("data"):
            if name not in used and time.time() - changed / 1000 >= hours * 3600:
                self._delete(f"data/{name}")

    # Plans

    def _key(self) -> Column:
        return F.struct(*[_col(k) for k in self.keys])

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*[_col(k) for k in self.by]), F.lit(buckets)).cast("int")

    def _rest(self, schema: StructType) -> list[str]:
        return [f.name for f in schema if f.name not in self.keys]

    def _row(self, schema: StructType) -> Column:
        """The values of a row; never null itself, and never without a field."""
        rest = self._rest(schema)
        return F.struct(*[_col(c) for c in rest]) if rest else F.struct(F.lit(True).alias("there"))

    def _schema(self, held: dict | None, batch: DataFrame) -> StructType:
        before = list(StructType.fromJson(held["schema"])) if held else []
        names = {f.name for f in before}
        return StructType([*before, *[f for f in batch.schema if f.name not in names]])

    def _rows(self, held: dict, buckets: Iterable[int] | None = None, schema: StructType | None = None) -> DataFrame:
        """The rows of a manifest, read with a schema that may be wider than that of the files."""
        schema = schema or StructType.fromJson(held["schema"])
        named = held["folders"].items() if buckets is None else [(str(b), held["folders"][str(b)]) for b in buckets if str(b) in held["folders"]]
        if not named:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in named]
        return self.spark.read.schema(StructType().add("row", schema)).parquet(*paths).select("row.*")

    def _reduced(self, batch: DataFrame, schema: StructType, buckets: int, at: str | None, keep_known: bool, sums: set[str]) -> tuple[DataFrame, int]:
        """``(bucket, key, b)``: one row for each key of the batch, combined in the map tasks and staged; and the rows left out."""
        complete = F.lit(True)
        for k in self.keys:
            complete = complete & _col(k).isNotNull()
        seen = Observation()
        rows = batch.observe(seen, F.count_if(~complete).alias("incomplete")).where(complete)
        types, rest = {f.name: f.dataType for f in schema}, self._rest(schema)
        order = _col(at) if at else F.lit(0)
        value = [(_col(c) if c in batch.columns else F.lit(None)).cast(types[c]).alias(f"c{i}") for i, c in enumerate(rest)]
        key = F.struct(*[_col(k).cast(types[k]).alias(k) for k in self.keys])
        rows = rows.select(key.alias("key"), order.alias("at"), *value)
        newest = F.max(F.struct("at", *[f"c{i}" for i in range(len(rest))]))

        def chosen(i: int, c: str) -> Column:
            x = F.col(f"c{i}")
            if c in sums:
                return F.sum(x).cast(types[c])
            known = F.max(F.when(x.isNotNull(), F.struct(F.col("at"), x)))
            return (known if keep_known else newest).getField(f"c{i}")

        row = F.struct(*[chosen(i, c).alias(c) for i, c in enumerate(rest)]) if rest else F.struct(F.lit(True).alias("there"))
        out = rows.groupBy("key").agg(row.alias("b"))
        dealt = F.pmod(F.xxhash64(*[F.col("key").getField(k) for k in self.by]), F.lit(buckets)).cast("int")
        out = staged(out.select(dealt.alias("bucket"), "key", "b"), "batch-by-key", keep=True)
        return out, _counted(seen, ["incomplete"])["incomplete"]

    def _met(self, held: dict | None, schema: StructType, buckets: int, new: DataFrame, touched: list[int]) -> DataFrame:
        """``(bucket, key, a, b)``: rows of the touched buckets and of the batch that share a key; one shuffle, by bucket.

        Grouping and the write both find the rows where that shuffle left them.
        """
        new = new.select("bucket", "key", F.lit(None).cast(new.schema["b"].dataType).alias("a"), "b")
        if held:
            old = self._rows(held, touched, schema).select(self._bucket(buckets).alias("bucket"), self._key().alias("key"), self._row(schema).alias("a"))
            new = old.withColumn("b", F.lit(None).cast(new.schema["b"].dataType)).union(new)
        one = lambda c: F.first(c, ignorenulls=True).alias(c)
        return new.repartition(max(len(touched), 1), "bucket").groupBy("bucket", "key").agg(one("a"), one("b"))

    def _write(self, both, counts, kept, pick, held, schema, buckets, touched, run) -> dict:
        """Write the touched buckets anew and publish the snapshot that names them."""
        folder, seen = uuid.uuid4().hex, Observation()
        observed = both.observe(seen, *[c.alias(n) for n, c in counts.items()]).where(kept)
        row = F.struct(*[(F.col("key").getField(f.name) if f.name in self.keys else pick(f.name).cast(f.dataType)).alias(f.name) for f in schema])
        observed.select("bucket", row.alias("row")).write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        again = set(map(str, touched))
        folders = {b: f for b, f in (held["folders"] if held else {}).items() if b not in again}
        folders |= {n.removeprefix("bucket="): folder for n in self._names(f"data/{folder}") if n.startswith("bucket=")}
        version = held["version"] + 1 if held else 1
        runs = (held["runs"] if held else {}) | ({run[0]: run[1]} if run else {})
        found = _counted(seen, counts)
        self._publish({"version": version, "keys": self.keys, "by": self.by, "buckets": buckets, "schema": schema.jsonValue(), "folders": folders, "runs": runs, "counts": found})
        return {"version": version, **found}

    @staticmethod
    def _has_run(held: dict | None, run: tuple[str, int] | None) -> bool:
        return bool(held and run and held["runs"].get(run[0], -1) >= run[1])

    # Files

    def _publish(self, manifest: dict) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        draft, place = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"manifests/{manifest['version']:010d}.json")
        files = draft.getFileSystem(conf)
        files.mkdirs(place.getParent())
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf)
        no_overwrite = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(no_overwrite, 1)
        how[0] = no_overwrite.NONE
        try:
            context.rename(draft, place, how)
        except Exception as error:
            files.delete(draft, False)
            if files.exists(place):
                raise Conflict(f"version {manifest['version']} of {self.path} exists") from error
            raise

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _listed(self, name: str) -> list[tuple[str, int]]:
        path = self._path(name)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [(s.getPath().getName(), s.getModificationTime()) for s in files.listStatus(path)] if files.exists(path) else []

    def _names(self, name: str) -> list[str]:
        return [n for n, _ in self._listed(name)]

    def _delete(self, name: str) -> None:
        path = self._path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _col(name: str) -> Column:
    """A column by its plain name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def _counted(seen: Observation, names: Iterable[str]) -> dict[str, int]:
    """The counts of a write that has ended; a plan that the optimizer finds empty reports none, not even zeros."""
    try:
        found = seen.get
    except Py4JJavaError:
        found = {}
    return {n: found.get(n, 0) for n in names}
