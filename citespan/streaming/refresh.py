"""Keeping an index fresh from a stream of file events, in any order and however often they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.snapshot import SEEN, RefreshReport, apply_changes
from ..operators.store import Change, SnapshotStore


def _order() -> Column:
    """Events of a path in order: by time, a deletion after what is written at that time, then by size and hash."""
    return F.struct("mtime", F.col("content").isNull().alias("deletion"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("hash", F.lit(b"")).alias("hash"))


def latest(events: DataFrame) -> DataFrame:
    """Of each path's events (path, size, mtime, content) the last; a null content is a deletion."""
    from ..functions.hashing import xxh3

    hashed = events.select("path", "size", "mtime", "content", xxh3(F.col("content")).alias("hash"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy(_order().desc()))
    return hashed.withColumn("rank", rank).filter("rank = 1").drop("rank")


def apply_events(events: DataFrame, store: SnapshotStore, now: int, stream: str | None = None, epoch: int = 0) -> RefreshReport | None:
    """Apply events (path, size, mtime, content) to the index; None if it has this batch of the stream already.

    A path's state is that of its last event by time, whatever order they come in: an event that isn't
    after the path's file in the index, or after its deletion, changes nothing.  So that late events don't bring a
    deleted file back, the index keeps the time of each deletion.  The batch's number becomes part of the
    same version as its changes.
    """
    from ..sources.repo import classified

    def work(change: Change) -> RefreshReport | None:
        if stream is not None and change.now["streams"].get(stream, -1) >= epoch:
            return None
        last = change.work("last", latest(events))
        files = change.read("files").select("path", F.struct("mtime", F.lit(False).alias("deletion"), "size", F.coalesce("hash", F.lit(b"")).alias("hash")).alias("had"))
        gone = change.read("deleted").select("path", F.struct("mtime", F.lit(True).alias("deletion"), F.lit(0).cast("long").alias("size"), F.lit(b"").alias("hash")).alias("went"))
        marked = last.join(files, "path", "left").join(gone, "path", "left").withColumn("mark", F.greatest("had", "went"))
        newer = change.work("newer", marked.filter(F.col("mark").isNull() | (_order() > F.col("mark"))).select("path", "size", "mtime", "content"))
        seen = change.work("seen", classified(newer.filter("content IS NOT NULL")).select(*SEEN))
        deleted = newer.filter("content IS NULL")
        report = apply_changes(change, seen, deleted, now)
        change.put("deleted", deleted.select("path", "mtime"), newer.select("path"))
        if stream is not None:
            change.stream(stream, epoch)
        change.commit(depends=("files", "dir_hashes", "deleted", "file_summaries"))
        return report

    return store.retried(work)


def refresh_stream(events: DataFrame, store: SnapshotStore, now: Callable[[], int], checkpoint: str, report: Callable[[RefreshReport], None] = lambda r: None, name: str | None = None) -> StreamingQuery:
    """Apply micro-batches of (path, size, mtime, content) to the index; available data, then stop.

    Files that a batch doesn't name stay as they are; one with null content is removed.  The index knows the last
    batch it has of each stream (its name, or else its checkpoint folder), so one that runs again after a failure
    changes nothing; events that are sent again change nothing either.
    """
    stream = name or checkpoint

    def apply(batch: DataFrame, epoch: int) -> None:
        done = apply_events(batch, store, now(), stream, epoch)
        if done:
            report(done)
        store.compact()

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
