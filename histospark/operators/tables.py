"""Result store, share-back, key/value state, logs and exports
(A8–A13, L6, L7).

The result store and the share-back copies are keyed tables of immutable
parquet folders under numbered manifests (:mod:`histospark.sources.manifest`):
a replacement writes the touched hash buckets anew, once, and becomes visible
as a whole; readers keep the version they opened, a crash in between leaves the
old one. Task retries are handled by Spark's commit protocol.
"""

from __future__ import annotations

import contextlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histospark.session import workspace_dir
from histospark.sources.manifest import Conflict, Manifests

RESULT_SCHEMA = T.StructType([
    T.StructField("asset", T.StringType()), T.StructField("signal", T.StringType()),
    T.StructField("domain", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("numeric_value", T.DoubleType()), T.StructField("is_anomaly", T.BooleanType()),
    T.StructField("anomaly_score", T.DoubleType()), T.StructField("forecast_value", T.DoubleType()),
    T.StructField("lower_bound", T.DoubleType()), T.StructField("upper_bound", T.DoubleType()),
    T.StructField("model_type", T.StringType()),
])
RESULT_COLUMNS = [f.name for f in RESULT_SCHEMA.fields]
RESULT_KEYS = ["model_type", "asset", "signal"]
CSV_TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"  # full microsecond precision
SHARE_SCHEMA = T.StructType(RESULT_SCHEMA.fields + [T.StructField("consumer_account", T.StringType())])


def as_results(df: DataFrame) -> DataFrame:
    """Conform anomaly or forecast rows to the result-store schema."""
    cols = []
    for f in RESULT_SCHEMA.fields:
        cols.append((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name))
    return df.select(*cols)


class KeyedStore:
    """A table in ``path`` whose rows are replaced and deleted by ``keys``.

    Rows lie in hash buckets of their keys. The number of buckets, the schema
    and the keys are those the table was made with, whatever it is opened with;
    a schema of other columns is refused."""

    RETRIES = 20

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets
        self.manifests = Manifests(spark, path)
        self._adopt(self.manifests.load())

    def _adopt(self, manifest: dict) -> dict:
        """Layout of the stored table; of a new one its own."""
        if manifest["version"]:
            schema = T.StructType.fromJson(manifest["schema"])
            if schema.fieldNames() != self.schema.fieldNames() or manifest["keys"] != self.keys:
                raise ValueError(f"{self.path} holds another table: {schema.simpleString()} by {manifest['keys']}")
            self.schema, self.buckets = schema, manifest["buckets"]
        return manifest

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _files(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{f}" for b, f in sorted(manifest.get("files", {}).items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (default: the latest). Its folders never
        change, so the frame stays the same whatever is written later."""
        return self._files(self.manifests.load(version))

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Write ``rows`` into a new folder: {bucket: folder below the table}."""
        folder = self.manifests.folder()
        write_partitions(self._bucketed(rows), folder, ["bucket"])
        below = folder.removeprefix(f"{self.manifests.root}/")
        return {n.removeprefix("bucket="): f"{below}/{n}" for n in self.manifests.children(folder) if n.startswith("bucket=")}

    def _publish(self, version: int, files: dict[str, str]) -> None:
        self.manifests.publish({"version": version, "schema": json.loads(self.schema.json()), "keys": self.keys, "buckets": self.buckets, "files": files})

    def replace(self, rows: DataFrame, keys: DataFrame | None = None) -> None:
        """Clear the rows of ``keys`` (a table of key columns; default: the
        keys in ``rows``) and add ``rows``. Keys without new rows end up empty,
        all other keys stay as they are. If another writer comes first, the
        replacement is made on top of what it published; buckets that it left
        alone are not written again."""
        names, base = self.schema.fieldNames(), self._adopt(self.manifests.load())
        rows = rows.select(*names)
        if not base["version"] and keys is None:  # nothing to clear
            with contextlib.suppress(Conflict):
                return self._publish(1, self._write(rows))
        given = rows.select(*self.keys) if keys is None else keys.select(*self.keys).unionByName(rows.select(*self.keys))
        path = workspace_dir(self.spark, "store-keys")
        given.distinct().write.parquet(path)
        gone, made, merged = self.spark.read.schema(given.schema).parquet(path), None, {}
        for _ in range(self.RETRIES):
            touched = [r["bucket"] for r in self._bucketed(gone).select("bucket").distinct().collect()]  # at most the number of buckets
            if not touched:
                return
            before = {str(b): base.get("files", {}).get(str(b)) for b in touched}
            if made != (self.buckets, before):
                match = [F.col(f"o.{k}").eqNullSafe(F.col(f"g.{k}")) for k in self.keys]
                old = self._files(base, touched).alias("o").join(gone.alias("g"), match, "left_anti")
                merged, made = self._write(old.select(*names).unionByName(rows)), (self.buckets, before)
            files = {b: f for b, f in base.get("files", {}).items() if b not in before} | merged
            try:
                return self._publish(base["version"] + 1, files)
            except Conflict:
                base = self._adopt(self.manifests.load())
        raise Conflict(f"{self.path}: {self.RETRIES} other writers came first")

    def delete(self, keys: DataFrame) -> None:
        self.replace(self.spark.createDataFrame([], self.schema), keys)

    def rebucket(self, buckets: int) -> None:
        """Deal the rows to another number of buckets."""
        base = self._adopt(self.manifests.load())
        rows, self.buckets = self._files(base), buckets
        try:
            self._publish(base["version"] + 1, self._write(rows))
        except Conflict:
            self._adopt(self.manifests.load())
            raise


def write_partitions(df: DataFrame, path: str, keys: list[str], mode: str = "overwrite") -> None:
    """Write ``df`` partitioned by ``keys``; in overwrite mode only the
    partitions present in ``df`` are replaced (dynamic overwrite).

    The ``rebalance`` hint hash-partitions rows by the keys and lets AQE
    coalesce small partitions (few files) and split skewed ones by size (a
    hot signal, or the single consumer of a share-back, is written by several
    tasks). Partitioning depends on row content only, so a retried task
    rewrites exactly the same rows."""
    (df.hint("rebalance", *keys).write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))


def result_store(spark: SparkSession, path: str | None = None) -> KeyedStore:
    """The result store in ``path`` (default: a new one), by (model_type, asset, signal)."""
    return KeyedStore(spark, path or workspace_dir(spark, "results"), RESULT_SCHEMA, RESULT_KEYS)


def store_results(spark: SparkSession, results: DataFrame, path: str | None = None) -> DataFrame:
    """Write anomaly/forecast rows into a result store and return the stored
    table: later copies and deletes read this table instead of recomputing the
    models."""
    store = result_store(spark, path)
    store.replace(as_results(results))
    return store.read()


def result_store_replace(spark: SparkSession, initial: DataFrame, replacement: DataFrame,
                         path: str | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Store ``initial`` results, then replace the rows of ``keys``
    (default: every (model_type, asset, signal) in ``replacement``); a key
    without new rows is cleared, other keys are untouched. Returns the store."""
    store = result_store(spark, path)
    store.replace(as_results(initial))
    store.replace(as_results(replacement), keys)
    return store.read()


def reset_keys(store: KeyedStore, gone) -> DataFrame:
    """Delete the rows of every key that has a row with ``gone`` true,
    in the store itself."""
    store.delete(store.read().where(gone).select(*store.keys).distinct())
    return store.read()


def share_back(spark: SparkSession, results: DataFrame, consumer: str, path: str | None = None,
               runs: int = 1) -> DataFrame:
    """Copy all results tagged with the consumer account, replacing that
    consumer's previous copy, also by an empty one. Running it again leaves
    the same rows. The copy is written once a run; a consumer's bucket is cut
    into files by size, so several tasks write it."""
    store = KeyedStore(spark, path or workspace_dir(spark, "share"), SHARE_SCHEMA, ["consumer_account"])
    tagged = as_results(results).withColumn("consumer_account", F.lit(consumer))
    own = spark.createDataFrame([(consumer,)], "consumer_account string")
    for _ in range(max(1, runs)):
        store.replace(tagged, own)
    return store.read()


def share_back_counts(shared: DataFrame) -> DataFrame:
    """Shared rows and anomalies per consumer."""
    return shared.groupBy("consumer_account").agg(
        F.count(F.lit(1)).alias("shared_count"),
        F.count_if(F.coalesce(F.col("is_anomaly"), F.lit(False))).alias("anomaly_count"))


def state_upsert(current: DataFrame, updates: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """A10: upsert by key; of several updates of a key the one with the
    greatest ``seq`` (a column that ``updates`` must have) wins, and any update
    wins over the current row; ``updated_at`` is refreshed for written keys."""
    if seq not in updates.columns:
        raise ValueError(f"updates need a column {seq} that orders the writes")
    cur = current.withColumn("_new", F.lit(0)).withColumn("_seq", F.lit(0).cast("long"))
    upd = (updates.withColumn("_new", F.lit(1)).withColumn("_seq", F.col(seq).cast("long"))
           .drop(*({seq} - set(current.columns))).withColumn("updated_at", F.current_timestamp()))
    both = cur.unionByName(upd, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(F.desc("_new"), F.desc_nulls_last("_seq"), *[F.desc(c) for c in sorted(set(current.columns) - {key, "updated_at"})])
    return both.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1).drop("_k", "_seq", "_new")


def seed_if_absent(current: DataFrame, defaults: DataFrame, key: str = "key") -> DataFrame:
    """Insert default rows only for keys that are missing."""
    missing = defaults.join(current.select(key), key, "left_anti")
    return current.unionByName(missing, allowMissingColumns=True)


def append_log(spark: SparkSession, rows: DataFrame, path: str | None = None, times: int = 1) -> DataFrame:
    """Append rows to a log table with a generated id and log time."""
    path = path or workspace_dir(spark, "log")
    logged = rows.withColumn("log_id", F.expr("uuid()")).withColumn("logged_at", F.current_timestamp())
    for _ in range(max(1, times)):
        logged.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def export_csv(spark: SparkSession, df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table as CSV with a header line (no index) and read it
    back with the same schema."""
    path = path or workspace_dir(spark, "csv")
    fmt = {"header": True, "timestampNTZFormat": CSV_TS_FORMAT, "timestampFormat": CSV_TS_FORMAT}
    df.write.mode("overwrite").options(**fmt).csv(path)
    return spark.read.schema(df.schema).options(**fmt).csv(path)
