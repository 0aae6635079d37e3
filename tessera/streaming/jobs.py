"""Structured Streaming jobs: windowed counts, facet deltas, rule transitions and the queue, each with exactly-once state.

State tables are Parquet folders in buckets and versions: a micro-batch writes the version of its own number from the versions before it, so
a batch that is run again after a failure writes the same version again and nothing is applied twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.facets import apply_deltas
from ..operators.quality import rule_transitions


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, window_end, keys, n) of tumbling or sliding windows; rows later than ``late`` don't count."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    counted = events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def session_counts(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """(window_start, window_end, keys, n) of sessions that end after ``gap`` without a row."""
    counted = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


class Versions:
    """A table in buckets by a hash of its key, in a folder with one version for each micro-batch that changed it.

    A version holds only the buckets that its batch touched, so a batch costs what it changes, not the whole table. Reading takes each bucket
    from the last version that has it. Versions that no bucket is read from are removed, but not for the sake of the last ``keep``
    ones (never with None), so that a batch that runs again finds the state it began with. Reading needs no key.
    """

    def __init__(self, spark: SparkSession, folder: str, key: list[str] | None = None, buckets: int = 64, keep: int | None = 8):
        self.spark, self.folder, self.key, self.buckets, self.keep = spark, folder.rstrip("/"), key, buckets, keep

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _touched(self, before: int | None = None) -> dict[int, list[int]]:
        """The finished versions (below ``before``) with the buckets that each wrote, by the names of empty files in it."""
        fs = self._fs()
        if not fs.exists(self._path()):
            return {}
        out = {}
        for s in fs.listStatus(self._path()):
            n = s.getPath().getName()
            if n[:1] == "v" and (before is None or int(n[1:]) < before) and fs.exists(self._path(n, "_done")):
                names = [x.getPath().getName() for x in fs.listStatus(self._path(n, "_touched"))]
                out[int(n[1:])] = [int(x) for x in names if x.isdigit()]
        return dict(sorted(out.items(), reverse=True))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(self.key or [])), F.lit(self.buckets)).cast("int")

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The table by the last versions (below ``before`` if given), or some buckets of it; None without a version."""
        fs, seen, paths, schema = self._fs(), set(), [], None
        touched = self._touched(before)
        for n, buckets in touched.items():
            schema = schema or self.spark.read.parquet(f"{self.folder}/v{n}/schema").schema
            for b in buckets:
                if b not in seen and (only is None or b in only) and fs.exists(self._path(f"v{n}", f"b{b}")):
                    paths.append(f"{self.folder}/v{n}/b{b}")
                seen.add(b)
        if schema is None:
            return None
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, number: int, touched: list[int]) -> None:
        """Version ``number``: the rows of the touched buckets, of which some may be empty now."""
        fs, name = self._fs(), f"v{number}"
        fs.delete(self._path(name), True)
        df.limit(0).coalesce(1).write.parquet(f"{self.folder}/{name}/schema")
        staged = f"{self.folder}/{name}/staged"
        df.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(staged)
        for b in touched:
            part = self._path(name, "staged", f"_bucket={b}")
            if fs.exists(part):
                fs.rename(part, self._path(name, f"b{b}"))
            fs.create(self._path(name, "_touched", str(b))).close()
        fs.delete(self._path(name, "staged"), True)
        fs.create(self._path(name, "_done")).close()
        self._clean(number)

    def _clean(self, number: int) -> None:
        """Remove versions that are replaced in every bucket by later ones, not counting the last ``keep``, whose batches may run again."""
        seen: set[int] = set()
        for i, (n, buckets) in enumerate(self._touched(number + 1).items()):
            if self.keep is None or i < self.keep:
                continue
            if set(buckets) <= seen:
                self._fs().delete(self._path(f"v{n}"), True)
            seen |= set(buckets)

    def change(self, rows: DataFrame, number: int, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
        """Write version ``number``: ``merge`` of the touched buckets' state (None without any) and the changed rows, which have the key."""
        touched = sorted(r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect())  # at most ``buckets``
        if touched:
            self.write(merge(self.read(number, touched), rows), number, touched)


def merge_facet_deltas(deltas: DataFrame, start: DataFrame, folder: str, checkpoint: str, buckets: int = 64) -> DataStreamWriter:
    """A stream of facet changes applied to a table of assignments: version n has all changes up to batch n.

    The table is ``start`` at first, written as version -1; a batch rewrites the buckets of the documents that it changes.
    """
    spark = start.sparkSession
    state = Versions(spark, folder, ["doc_id"], buckets)
    if state.read() is None:
        state.write(start.select("doc_id", "facet_name", "facet_value").distinct(), -1, list(range(buckets)))

    def apply(batch: DataFrame, number: int) -> None:
        batch.persist()
        state.change(batch, number, apply_deltas)
        batch.unpersist()

    return deltas.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def track_rules(changes: DataFrame, evaluate: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, buckets: int = 64) -> DataStreamWriter:
    """Rule states over a stream: each micro-batch of changes is evaluated to (rule_id, entity_id, state); states are versions below
    ``folder``/states, of which a batch rewrites the touched buckets, the events of each batch are a version below ``folder``/events. Event
    ids are hashes, so a repeated batch makes the same events."""
    spark = changes.sparkSession
    states = Versions(spark, f"{folder}/states", ["rule_id", "entity_id"], buckets)
    events = Versions(spark, f"{folder}/events", ["event_id"], 1, None)

    def apply(batch: DataFrame, number: int) -> None:
        now = evaluate(batch).select("rule_id", "entity_id", "state").persist()
        touched = sorted(r["b"] for r in now.select(states.bucket().alias("b")).distinct().collect())
        after, happened = rule_transitions(states.read(number, touched), now, str(number))
        events.write(happened, number, [0])
        if touched:
            states.write(after, number, touched)
        now.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def consume_queue(messages: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str, per_batch: str = "1 second") -> DataStreamWriter:
    """A queue as a stream: a message is settled when its micro-batch has been handled, else it is handled again."""
    return messages.writeStream.foreachBatch(lambda batch, _: handle(batch)).option("checkpointLocation", checkpoint).trigger(processingTime=per_batch)
