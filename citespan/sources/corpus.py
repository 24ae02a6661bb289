"""Document tables in the shape of index tables, so that every operator runs over them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grams
from ..schemas import GRAM_BLOCKS

EPOCH = 1_704_067_200


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path():
    return F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, hash (md5), mtime, size, lang, is_binary of documents."""
    docs = _read(spark, sf_dir, "documents")
    return docs.select(_path().alias("path"), F.md5(F.col("text").cast("binary")).alias("hash"), (F.lit(EPOCH) + F.col("doc_id") * 60).alias("mtime"), F.octet_length("text").cast("long").alias("size"), "lang", F.lit(False).alias("is_binary"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, lang of documents; the text isn't read."""
    return _read(spark, sf_dir, "documents").select(_path().alias("path"), "lang")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content of documents."""
    return _read(spark, sf_dir, "documents").select(_path().alias("path"), F.col("text").alias("content"))


_indexes: dict[tuple, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share, under spark.checkpoint.dir.

    Where that is unset and all runs in one machine's JVM, as in tests, it is a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return f"{shared.rstrip('/')}/citespan-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="citespan-") + "/made"


def _state(spark: SparkSession, path: str) -> tuple:
    """Length, number of files and last change of a table, which another state of the table doesn't share."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    of = fs.getContentSummary(at)
    return of.getLength(), of.getFileCount(), fs.getFileStatus(at).getModificationTime()


def gram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRAM_BLOCKS of documents, each file sorted by gram; written at the first call of a session for this state of the table."""
    key = (spark.sparkContext.applicationId, sf_dir, *_state(spark, f"{sf_dir}/documents.parquet"))
    if key not in _indexes:
        folder = scratch(spark)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = grams.gram_blocks(contents(spark, sf_dir).repartition(n))  # the texts are dealt out, whatever files they stand in
        rows.sortWithinPartitions("gram", "block").write.parquet(folder)
        _indexes[key] = folder
    return spark.read.schema(GRAM_BLOCKS).parquet(_indexes[key])


def _url_path(url):
    """The part of a url after its scheme, without query, fragment and slash at the end."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://", ""), r"[?#].*$|/$", "")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path of pages, from their urls."""
    return _read(spark, sf_dir, "pages").select("page_id", F.regexp_replace(_url_path(F.col("url")), "/$", "").alias("path"))


def page_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, name, kind, start_line, end_line: the titles, headings and links of pages; kind is the tag."""
    read = _read(spark, sf_dir, "pages").select(F.regexp_replace(_url_path(F.col("url")), "/$", "").alias("path"), "html")
    out = None
    for tag in ("title", "h1", "a"):
        found = read.select("path", F.explode(F.regexp_extract_all("html", F.lit(f"<{tag}(?: [^>]*)?>([^<]*)</{tag}>"), 1)).alias("name"), F.lit(tag).alias("kind"))
        out = found if out is None else out.unionByName(found)
    return out.filter("name != ''").select("path", "name", "kind", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path (brand), name, kind (type), start_line (size) of parts."""
    return _read(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").alias("start_line"), F.col("p_size").alias("end_line"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old, new) files of documents: every 7th is missing in old, every 11th in new, every 5th has another
    hash in new, every 3rd another time."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", _path().alias("path"), "text")
    row = lambda text, late: [F.col("path"), F.md5(text.cast("binary")).alias("hash"), (F.lit(EPOCH) + F.col("doc_id") * 60 + late).alias("mtime"), F.octet_length(text).cast("long").alias("size")]
    old = docs.filter("doc_id % 7 != 0").select(*row(F.col("text"), F.lit(0)))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    late = F.when((F.col("doc_id") % 5 == 0) | (F.col("doc_id") % 3 == 0), 1).otherwise(0)
    return old, docs.filter("doc_id % 11 != 0").select(*row(changed, late))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, start_line, end_line: a span for each line item, over its order's part of a file of 64 parts."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    start = (F.col("l_partkey") % 500 + 1).cast("int")
    return li.select(F.concat(F.lit("src/f"), (F.col("l_orderkey") % 997).cast("string"), F.lit(".py")).alias("path"), start.alias("start_line"), (start + (F.col("l_quantity") % 7).cast("int")).alias("end_line"))


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq, tool, cost of conversations."""
    return _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.col("role").alias("tool"), F.octet_length("text").cast("long").alias("cost"))
