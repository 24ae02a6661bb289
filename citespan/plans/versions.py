"""Queries of an index that has been changed many times, by batches and by a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import snapshot
from ..sources import corpus
from ..streaming.refresh import refresh_stream
from .catalogue import SNAPSHOTS
from .registry import query


@query("refresh_delta", f"WITH {SNAPSHOTS} SELECT path, hash, CASE WHEN size % 29 IN (3, 5, 7, 9) THEN size % 29 ELSE mtime END AS mtime, size FROM new WHERE size % 29 NOT IN (4, 6, 8, 10)")
def refresh_delta(spark, d):
    """The file table after ten changes on top of each other and a merge of the buckets that they crowd: the
    second snapshot's changes and deletions, then files with new times and deleted files in turn."""
    old, new = corpus.snapshots(spark, d)
    shaped = lambda df: df.select("path", F.col("hash").cast("binary").alias("hash"), "mtime", "size", F.lit(None).cast("string").alias("lang"), F.lit(False).alias("is_binary"), F.lit(1).cast("long").alias("updated_at"))
    index = snapshot.SnapshotStore(spark, corpus.scratch(spark))

    def put(rows, touched):
        change = index.begin()
        change.put("files", rows and shaped(rows), touched)
        change.commit()

    put(old, None)
    other = new.join(old, ["path", "hash", "mtime", "size"], "left_anti")
    put(other, other.select("path").unionByName(old.select("path").join(new, "path", "left_anti")))
    for k in range(3, 11):
        some = new.filter(F.col("size") % 29 == k)
        put(some.withColumn("mtime", F.lit(k).cast("long")) if k % 2 else None, some)
    index.compact()
    return index.read("files").select("path", F.col("hash").cast("string").alias("hash"), "mtime", "size")


@query("refresh_events", """WITH e AS (SELECT 'u' || user_id || '/' || event_type || '.txt' AS path, CAST(strlen(props) AS BIGINT) AS size, epoch_us(ts) AS mtime, event_id % 5 = 0 AS gone, event_id FROM events)
  SELECT path, arg_max(size, mtime) AS size, max(mtime) AS mtime FROM e GROUP BY path HAVING NOT arg_max(gone, mtime)""")
def refresh_events(spark, d):
    """The files of an index after a stream of all events, dealt out of order to micro-batches, a third of them twice:
    each event is a file's new text, or its deletion."""
    events = spark.read.parquet(f"{d}/events.parquet")
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), "event_type", F.lit(".txt"))
    content = F.when(F.col("event_id") % 5 != 0, F.encode("props", "UTF-8"))
    rows = events.select(path.alias("path"), F.coalesce(F.octet_length(content), F.lit(0)).cast("long").alias("size"), F.unix_micros(F.concat(F.col("ts").cast("string"), F.lit(" UTC")).cast("timestamp")).alias("mtime"), content.alias("content"), F.pmod(F.xxhash64("event_id"), F.lit(3)).alias("part"))
    folder = corpus.scratch(spark)
    for part in (2, 0, 1, 2):
        rows.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/events")
    index = snapshot.SnapshotStore(spark, f"{folder}/index")
    stream = spark.readStream.schema("path string, size long, mtime long, content binary").option("maxFilesPerTrigger", 2).parquet(f"{folder}/events")
    refresh_stream(stream, index, lambda: 1, f"{folder}/progress").awaitTermination()
    return index.read("files").select("path", "size", "mtime")
