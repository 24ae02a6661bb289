"""Resharding by minimum-cost flow: from the old shards' sizes to new capacities, moving the fewest bytes.

Old shard i keeps its number.  A flow network has an edge from each old shard to each new one, free where
the number is the same and one a byte elsewhere; the cheapest flow that fills the capacities says how
many bytes of each old shard stay and how many go where.  An old shard's rows stand in a fixed order, and
the flow cuts that order into one run of bytes for each new shard, so that a document's place follows
from the bytes before it: sums by partition, then within each partition, never one list of everything.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, table

OLD_SHARDS, NEW_SHARDS = 5, 8
#: Equal texts stay in one shard in runs of up to 1/RUN_PART of a shard's capacity.
RUN_PART = 256


def min_cost_flow(supply: list[int], capacity: list[int]) -> list[list[int]]:
    """flow[i][j]: bytes of old shard i for new shard j.  Successive cheapest paths on the shards alone.

    The capacities must add up to the supplies.
    """
    m, n = len(supply), len(capacity)
    if sum(supply) != sum(capacity):
        raise ValueError("capacities must add up to the old shards' sizes")
    flow, left, room = [[0] * n for _ in range(m)], list(supply), list(capacity)
    cost = lambda i, j: 0 if i == j else 1
    while any(left):
        best = {("old", i): 0 for i in range(m) if left[i]}
        came: dict[tuple, tuple] = {}
        todo = deque(best)
        while todo:  # Bellman-Ford with a queue: back edges have negative costs
            kind, k = at = todo.popleft()
            for o in range(n if kind == "old" else m):
                to, d = (("new", o), cost(k, o)) if kind == "old" else (("old", o), -cost(o, k))
                if kind == "new" and not flow[o][k]:
                    continue
                if best[at] + d < best.get(to, 1 << 60):
                    best[to], came[to] = best[at] + d, at
                    if to not in todo:
                        todo.append(to)
        path = [min((("new", j) for j in range(n) if room[j]), key=lambda x: (best[x], x[1]))]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        amount = min(left[path[0][1]], room[path[-1][1]], *(flow[b[1]][a[1]] for a, b in zip(path, path[1:]) if a[0] == "new"), 1 << 62)
        for a, b in zip(path, path[1:]):
            if a[0] == "old":
                flow[a[1]][b[1]] += amount
            else:
                flow[b[1]][a[1]] -= amount
        left[path[0][1]] -= amount
        room[path[-1][1]] -= amount
    return flow


def even(total: int, n: int) -> list[int]:
    return [total * (j + 1) // n - total * j // n for j in range(n)]


def _cuts(flow: list[list[int]]) -> list[tuple[int, int, int]]:
    """(old shard, first byte, new shard), in order; what stays comes first."""
    rows = []
    for i, amounts in enumerate(flow):
        at = 0
        for j in sorted(range(len(amounts)), key=lambda j: (j != i, j)):
            if amounts[j]:
                rows.append((i, at, j))
                at += amounts[j]
    return rows


def _shard_at(old: Column, at: Column, cuts: list[tuple[int, int, int]]) -> Column:
    """The new shard of byte ``at`` of old shard ``old``; there are fewer cuts than shards, old and new."""
    out = F.lit(None).cast("int")
    for i, first, j in cuts:
        out = F.when((old == i) & (at >= first), F.lit(j)).otherwise(out)
    return out


def reshard(docs: DataFrame, new_shards: int = NEW_SHARDS, old_shards: int = OLD_SHARDS, old_shard: Column | None = None, row: Column | None = None) -> tuple[DataFrame, list[list[int]]]:
    """(doc_id, size, text_crc32, old_shard, shard, slot for each row of docs; the flow in bytes).

    row: a number that tells rows apart; where it is given, the result has it as column ``row``.

    A row's size is its text's UTF-8 bytes plus 1, so that null and empty texts count.  old_shard, where
    not given, is the hash of the text modulo old_shards; equal texts then start in one shard, and stay
    in one in runs of up to a 256th of a capacity.  Shard sizes are equal but for half such a run or half a
    document at each cut.  slot: the row's place in its shard, from 0 without a gap.  Repeated rows are
    rows of their own; an empty table gives no rows.  Only doc_id and text are read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = [] if row is None else [row.cast("long").alias("row")]
    names = ["row"] * len(named)
    slim = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"), (F.pmod(F.xxhash64(text), F.lit(old_shards)) if old_shard is None else old_shard).cast("int").alias("old_shard"),
        *named,
    )
    ranged = slim.repartitionByRange("old_shard", "text_hash", "doc_id")
    rows = cut(ranged.withColumn("part", F.spark_partition_id()))  # the partitions must be the same ones from here on
    order = ["text_hash", "doc_id", "size", *names]
    sums = rows.groupBy("part", "old_shard").agg(F.sum("size").alias("bytes"))
    sizes = {r.old_shard: r.bytes for r in sums.groupBy("old_shard").agg(F.sum("bytes").alias("bytes")).collect()}  # a row for each old shard
    supply = [sizes.get(i, 0) for i in range(old_shards)]
    capacity = even(sum(supply), new_shards)
    flow = min_cost_flow(supply, capacity)
    earlier = Window.partitionBy("old_shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", "old_shard", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("before"))
    here = Window.partitionBy("part", "old_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = rows.join(starts, ["part", "old_shard"]).withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(here), F.lit(0)))
    # A run of equal texts takes its middle byte's shard, so that each cut is missed by half a run at most.
    same = Window.partitionBy("part", "old_shard", "text_hash")
    at = at.withColumn("run", F.floor((F.col("at") - F.min("at").over(same)) / max(1, min(capacity, default=1) // RUN_PART)))
    together = Window.partitionBy("part", "old_shard", "text_hash", "run")
    at = at.withColumn("at", F.min("at").over(together) + F.floor(F.sum("size").over(together) / 2))
    placed = cut(at.select("doc_id", "size", "text_crc32", "text_hash", "old_shard", "part", *names, _shard_at(F.col("old_shard"), F.col("at"), _cuts(flow)).alias("shard")))
    counts = placed.groupBy("part", "shard").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    slot = F.col("before") + F.row_number().over(Window.partitionBy("part", "shard").orderBy("old_shard", *order)) - 1
    return placed.join(starts, ["part", "shard"]).select("doc_id", "size", "text_crc32", "old_shard", "shard", slot.cast("long").alias("slot"), *names), flow


def affected(flow: list[list[int]]) -> list[int]:
    """The shards whose files must be written anew: those that bytes leave or enter."""
    shards = range(max(len(flow), max(map(len, flow), default=0)))
    moved = lambda k: (k < len(flow) and any(b and j != k for j, b in enumerate(flow[k]))) or any(k < len(row) and row[k] and i != k for i, row in enumerate(flow))
    return [k for k in shards if moved(k)]


def write(docs: DataFrame, folder: str, shard: Column, name: str | None = None) -> str:
    """Lay docs out as shards: folder/name=k holds the rows whose shard is k; the name used.

    name is ``shard``, with underscores after it where docs has such a column already.
    """
    name = name or fresh(docs, "shard")
    docs.withColumn(name, shard.cast("int")).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(name).parquet(folder)
    return name


def _side(folder: str) -> str:
    """Where a rewrite keeps its rows and plan; readers of the folder don't see names with an underscore before them."""
    return f"{folder.rstrip('/')}/_resharding"


def _swap(fs, path, folder: str, name: str, shard: int, filled: bool) -> None:
    """Put a shard's new files in the place of its old ones; again, if that was broken off."""
    new, old = path(f"{_side(folder)}/rows/{name}={shard}"), path(f"{folder}/{name}={shard}")
    if filled and not fs.exists(new):
        return  # done before
    fs.delete(old, True)
    if filled and not fs.rename(new, old):
        raise OSError(f"can't rename to {old}")


def finish(spark: SparkSession, folder: str) -> bool:
    """Complete a rewrite of the folder that was broken off; whether there was one with a plan.

    Without a plan no file of the shards has been touched, and what was written beside them goes.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    at = path(f"{_side(folder)}/plan.json")
    planned = fs.exists(at)
    if planned:
        stream = fs.open(at)
        told = json.loads(bytes(stream.readAllBytes()).decode())
        stream.close()
        for shard, filled in told["shards"]:
            _swap(fs, path, folder, told["name"], shard, filled)
    fs.delete(path(_side(folder)), True)
    return planned


def rewrite(spark: SparkSession, folder: str, new_shards: int, name: str = "shard") -> list[int]:
    """Reshard the shards folder/name=0 ... in place, moving the fewest bytes; the shards that changed.

    Only the affected shards' files are written; a shard that ends empty, or has a number from new_shards
    on, goes.  Each row that is there stays exactly once, whatever its columns hold: rows are told apart by
    a number of their own, so null and repeated ids don't matter.

    All new files are written beside the shards first, then a plan that names them, and only then are shards
    swapped one by one.  A run that is broken off is completed by ``finish``, which the next rewrite calls too:
    before the plan is there nothing has changed, after it the swaps go on where they stopped.
    """
    finish(spark, folder)
    read = spark.read.option("basePath", folder).parquet(folder)
    row = fresh(read, "row_number")
    tagged = cut(read.withColumn(row, F.monotonically_increasing_id()))
    old_shards = (tagged.agg(F.max(name)).first()[0] or 0) + 1
    placed, flow = reshard(tagged.select(*[c for c in ("doc_id", "text") if c in read.columns], F.col(name), F.col(row)), new_shards, old_shards, F.col(name), F.col(row))
    shards = affected(flow)
    target = fresh(tagged, "target")
    moving = placed.filter(F.col("shard").isin([k for k in shards if k < new_shards])).select(F.col("row").alias(row), F.col("shard").alias(target))
    moved = cut(tagged.join(moving, row).drop(row, name).withColumnRenamed(target, name))
    filled = {r[0] for r in moved.select(name).distinct().collect()}
    moved.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(name).parquet(f"{_side(folder)}/rows")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(path(f"{_side(folder)}/plan.new"), True)
    stream.write(bytearray(json.dumps({"name": name, "shards": [[k, k in filled] for k in shards]}).encode()))
    stream.close()
    fs.rename(path(f"{_side(folder)}/plan.new"), path(f"{_side(folder)}/plan.json"))
    finish(spark, folder)
    return shards


def op9_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents from 5 shards, dealt by the hash of the text, into 8 of near equal bytes."""
    placed, _ = reshard(table(spark, sf_dir, "documents", "doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
