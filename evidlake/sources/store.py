"""Tables of records under keys, in hash buckets, written whole or not at all (K1-K5 as writes).

A table is a folder:

* ``data/<write>/bucket=<n>``: the current records of a bucket, as the write that last changed it left them;
* ``log/<write>``: what a write made of each record it was given, with the outcome, so also every revision there ever was;
* ``manifests/<version>``: which write holds each bucket, which writes are in the log, and the last batch of each stream.

A write reads only the buckets that its keys fall in, and writes anew only those in which something was inserted or revised. The manifest comes
last and appears by one rename that fails if the version is there already: a write that is killed before leaves the old table as it was, and of two
writers at a time the later one starts again from the other's result. The data, the log with its conflicts and the batch id thus become
visible together. The driver holds a manifest (one entry a bucket) and the numbers of touched buckets, never keys.

Outcomes: INSERTED, REVISED, UNCHANGED; and, without effect on the table, CONFLICT (other content under the key of an immutable record, or two contents
in one write), IDENTITY_COLLISION (the stored record's identity columns differ), MISSING_ENDPOINT, NULL_KEY.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

EFFECTIVE = ("INSERTED", "REVISED")


class StaleWrite(RuntimeError):
    """Another writer has published the version that this one was to be."""


class Folder:
    """Small files and atomic renames on whatever store Spark's paths name."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(conf)
        self.path = self.fs.makeQualified(self.path)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path.toUri(), conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path)) if self.fs.exists(self.path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """The file is there with all its text, or not at all; an existing one is never replaced."""
        draft = self._at(f".{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        chosen = self.gateway.new_array(options, 1)
        chosen[0] = options.NONE
        try:
            self.context.rename(draft, self._at(name), chosen)
        except Exception as error:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise StaleWrite(name) from error
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


@dataclass
class Manifest:
    version: int
    key: str
    schema: str  # of a record, without its revision
    buckets: int
    data: dict[str, str] = field(default_factory=dict)  # bucket -> write
    log: list[str] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)  # stream -> last batch


class RecordStore:
    """One table. ``put`` writes records; ``current``, ``log`` and ``lookup`` read them."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._manifests = Folder(spark, f"{self.root}/manifests")

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: StructType, key: str, buckets: int = 256) -> RecordStore:
        """The table at ``root``, made if it isn't there. The number of buckets stays: choose it so that a bucket is some 100 MB at the size the table will have."""
        store = cls(spark, root)
        if not store._versions():
            try:
                store._publish(Manifest(0, key, json.dumps(schema.jsonValue()), buckets))
            except StaleWrite:
                pass  # another has just made it
        return store

    def _versions(self) -> list[str]:
        return [n for n in self._manifests.names() if not n.startswith(".")]

    def _publish(self, manifest: Manifest) -> None:
        self._manifests.publish(f"{manifest.version:012d}", json.dumps(asdict(manifest)))

    def manifest(self) -> Manifest:
        return Manifest(**json.loads(self._manifests.read(self._versions()[-1])))

    # --- reading -----------------------------------------------------------------------------------------------------

    def _schema(self, m: Manifest) -> StructType:
        return StructType.fromJson(json.loads(m.schema)).add("revision", IntegerType())

    def _read(self, m: Manifest, buckets: list[int] | None = None) -> DataFrame:
        at = sorted(map(int, m.data)) if buckets is None else [b for b in buckets if str(b) in m.data]
        schema = self._schema(m)
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{m.data[str(b)]}/bucket={b}" for b in at])

    def current(self) -> DataFrame:
        return self._read(self.manifest())

    def log(self) -> DataFrame:
        """All that was given to the table, with ``outcome``, ``revision`` and ``write``."""
        m = self.manifest()
        schema = self._schema(m).add("outcome", StringType()).add("write", StringType())
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/log/{w}" for w in m.log]) if m.log else self.spark.createDataFrame([], schema)

    def history(self) -> DataFrame:
        return self.log().where(F.col("outcome").isin(*EFFECTIVE)).drop("outcome", "write")

    def _bucket(self, column: str, m: Manifest) -> Column:
        """The hash depends on the type, so keys of other tables are cast to that of this one."""
        return F.pmod(F.xxhash64(F.col(column).cast(self._schema(m)[m.key].dataType)), F.lit(m.buckets)).cast("int")

    def _touched(self, keys: DataFrame, column: str, m: Manifest) -> list[int]:
        """Numbers of the buckets of the keys: at most as many as the table has."""
        return sorted(r[0] for r in keys.select(self._bucket(column, m)).distinct().collect())

    def lookup(self, keys: DataFrame, column: str) -> DataFrame:
        """Current records whose key is in ``keys.column``, from their buckets only."""
        m = self.manifest()
        held = self._read(m, self._touched(keys.where(F.col(column).isNotNull()), column, m))
        return held.join(keys.select(F.col(column).alias(m.key)), m.key, "left_semi")

    # --- writing -----------------------------------------------------------------------------------------------------

    def put(
        self,
        records: DataFrame,
        digest: str,
        immutable: bool = False,
        identity: tuple[str, ...] = (),
        endpoints: dict[str, RecordStore] | None = None,
        batch: tuple[str, int] | None = None,
        attempts: int = 5,
    ) -> DataFrame:
        """Outcome and revision of each distinct record; all of them take effect together.

        ``digest`` tells contents apart. ``immutable``: other content under a key that is there is a conflict, not a revision. ``identity``:
        columns that a revision may not change. ``endpoints``: columns and the tables that must hold their value. ``batch``: (stream,
        number); a batch not after the stream's last one has been written before, and nothing happens.
        """
        for _ in range(attempts):
            m = self.manifest()
            if batch and m.batches.get(batch[0], -1) >= batch[1]:
                return self.log().limit(0)
            try:
                return self._put(m, records, digest, immutable, identity, endpoints or {}, batch)
            except StaleWrite:
                continue
        raise StaleWrite(f"{attempts} attempts")

    def _put(self, m: Manifest, records: DataFrame, digest: str, immutable: bool, identity: tuple[str, ...], endpoints: dict[str, RecordStore], batch: tuple[str, int] | None) -> DataFrame:
        write, names = uuid.uuid4().hex, [f.name for f in self._schema(m) if f.name != "revision"]
        given = f"{self.root}/given/{write}"  # once, so that all steps see the same records
        records.select(*names).write.parquet(given)
        rows = self.spark.read.schema(self._schema(m)).parquet(given).select(*names)
        touched = self._touched(rows.where(F.col(m.key).isNotNull()), m.key, m)
        self._judged(m, rows, touched, digest, immutable, identity, endpoints).withColumn("write", F.lit(write)).write.parquet(f"{self.root}/log/{write}")
        log = self.spark.read.schema(self._schema(m).add("outcome", StringType()).add("write", StringType())).parquet(f"{self.root}/log/{write}")
        taken = log.where(F.col("outcome").isin(*EFFECTIVE)).drop("outcome", "write")
        changed = self._touched(taken, m.key, m)
        if changed:
            held = self._read(m, changed)
            merged = held.join(taken.select(m.key), m.key, "left_anti").unionByName(taken)
            merged.withColumn("bucket", self._bucket(m.key, m)).repartition(len(changed), "bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{write}")
        batches = m.batches | ({batch[0]: batch[1]} if batch else {})
        self._publish(Manifest(m.version + 1, m.key, m.schema, m.buckets, m.data | {str(b): write for b in changed}, [*m.log, write], batches))
        Folder(self.spark, f"{self.root}/given").delete(write)
        return log.drop("write")

    def _judged(self, m: Manifest, rows: DataFrame, touched: list[int], digest: str, immutable: bool, identity: tuple[str, ...], endpoints: dict[str, RecordStore]) -> DataFrame:
        key = F.col(m.key)
        versions = rows.groupBy(m.key).agg((F.min(digest).eqNullSafe(F.max(digest)) & (F.count(digest).isin(0) | (F.count(digest) == F.count("*")))).alias("one_content"))
        fields = [F.col("revision").alias("held_revision"), F.col(digest).alias("held_digest"), *[F.col(c).alias(f"held_{k}") for k, c in enumerate(identity)]]
        held = self._read(m, touched).select(m.key, *fields)
        judged = rows.dropDuplicates([m.key, digest]).join(versions, m.key, "left").join(held, m.key, "left")
        lost = F.lit(False)
        for k, (column, table) in enumerate(endpoints.items()):
            there = table.lookup(rows, column).select(F.col(table.manifest().key).alias(column), F.lit(True).alias(f"there_{k}"))
            judged = judged.join(there, column, "left")
            lost = lost | F.col(f"there_{k}").isNull()
        fresh, same = F.col("held_revision").isNull(), F.col("held_digest").eqNullSafe(F.col(digest))
        other = F.lit(False)
        for k, c in enumerate(identity):
            other = other | ~F.col(f"held_{k}").eqNullSafe(F.col(c))
        outcome = F.when(key.isNull(), "NULL_KEY").when(~F.col("one_content"), "CONFLICT").when(lost, "MISSING_ENDPOINT").when(fresh, "INSERTED").when(other, "IDENTITY_COLLISION")
        outcome = outcome.when(same, "UNCHANGED").otherwise("CONFLICT" if immutable else "REVISED")
        revision = F.when(F.col("outcome").isin(*EFFECTIVE), F.coalesce("held_revision", F.lit(0)) + 1).otherwise(F.col("held_revision"))
        return judged.withColumn("outcome", outcome).select(*rows.columns, revision.cast("int").alias("revision"), "outcome")

    def put_latest(self, records: DataFrame, order: str) -> None:
        """Of each key only the record that is last in ``order`` stays, in the table as among the new (K5). Nothing goes to the log."""
        for _ in range(5):
            try:
                m, write = self.manifest(), uuid.uuid4().hex
                touched = self._touched(records.where(F.col(m.key).isNotNull()), m.key, m)
                names = [f.name for f in self._schema(m)]
                rows = self._read(m, touched).unionByName(records.where(F.col(m.key).isNotNull()).withColumn("revision", F.lit(1)).select(*names))
                last = rows.groupBy(m.key).agg(F.max_by(F.struct(*names), F.col(order)).alias("r")).select("r.*")
                last.withColumn("bucket", self._bucket(m.key, m)).repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{write}")
                self._publish(Manifest(m.version + 1, m.key, m.schema, m.buckets, m.data | {str(b): write for b in touched}, m.log, m.batches))
                return
            except StaleWrite:
                continue
        raise StaleWrite("5 attempts")

    def compact_log(self) -> None:
        """One folder in place of the log's many: a manifest names every folder of the log, so a table of many small writes should have it done now and then."""
        m, write = self.manifest(), uuid.uuid4().hex
        if len(m.log) > 1:
            self.log().write.parquet(f"{self.root}/log/{write}")
            self._publish(Manifest(m.version + 1, m.key, m.schema, m.buckets, m.data, [write], m.batches))

    def vacuum(self) -> int:
        """Removes manifests before the last and what no manifest needs: of killed, replaced and stale writes. Not beside a running write or reader of old versions."""
        m = self.manifest()
        for name in self._versions()[:-1]:
            self._manifests.delete(name)
        gone = 0
        for part, kept in (("data", set(m.data.values())), ("log", set(m.log)), ("given", set())):
            folder = Folder(self.spark, f"{self.root}/{part}")
            for name in folder.names():
                if name not in kept:
                    folder.delete(name)
                    gone += 1
        return gone
