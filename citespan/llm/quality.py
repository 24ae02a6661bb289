"""Quality by compression: how much better a text compresses with a dictionary of good text than of bad text.

Two zstandard dictionaries are trained, one on texts labelled good and one on bad ones.  A text is compressed
with each, block by block.  The difference of the two sizes, normalised by the raw size (``POWER``), is the only
thing known of a text; a logistic function of it, fitted on labelled texts that the dictionaries in use there
were not made of, makes it a probability.

Training reads a bounded sample of the labelled rows (``TRAIN_DOCS``, ``TRAIN_BYTES``), whole texts of it
both in the dictionaries and in the fit; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_of, claim, table

#: The sample: of each label, the rows with the smallest crc32 of doc_id, at most so many, and of these as
#: many as have so many bytes of text together.
TRAIN_DOCS, TRAIN_BYTES = 3000, 24_000_000
#: Bytes of each dictionary, of the pieces of text that it is trained on, and of each block compressed by itself.
DICTIONARY_BYTES, PIECE_BYTES, BLOCK_BYTES = 400_000, 1_000, 16_384
LEVEL = 3
#: Parts of the sample; each is fitted on with dictionaries of the others.
FOLDS = 5
#: The size difference is taken over the raw size to this power.  By the size itself (1) short texts, where
#: a few bytes more or less are chance, come out too far apart.
POWER = 0.75
#: Scores from which a text is predicted to be of label 1, and below which a filter rejects it: a filter
#: takes out what is likelier bad than good.
THRESHOLD, REJECT = 0.7, 0.5
SCORED = "doc_id long, score double"


class Compressors:
    """Sizes of texts compressed with the good and with the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.by = []
        for raw in (good, bad):
            data = zstandard.ZstdCompressionDict(raw)
            data.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, text: str) -> float:
        """How many bytes more the text takes with the bad dictionary, normalised; 0 for an empty text."""
        raw = text.encode()
        good = bad = 0
        for i in range(0, len(raw), BLOCK_BYTES):
            block = raw[i : i + BLOCK_BYTES]
            good += len(self.by[0].compress(block))
            bad += len(self.by[1].compress(block))
        return (bad - good) / max(1, len(raw)) ** POWER


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method, halving steps that make the fit worse; the weights' last is a constant's."""
    a = np.column_stack([x, np.ones(len(x))])

    def loss(w):
        z = a @ w
        return np.sum(np.logaddexp(0, z) - y * z) + ridge / 2 * w @ w

    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w


class Model:
    """What the executors get: two dictionaries of bounded size and three numbers."""

    def __init__(self, good: bytes, bad: bytes, slope: float, offset: float, scale: float):
        self.good, self.bad, self.slope, self.offset, self.scale = good, bad, slope, offset, scale

    def bent(self, differences: np.ndarray) -> np.ndarray:
        """Differences on a scale that grows as they do, but less for large ones."""
        return np.arcsinh(np.asarray(differences, float) / self.scale)

    def score(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.bent(differences) + self.offset, -30, 30)))


def dictionary(texts: list[str]) -> bytes:
    """A zstandard dictionary trained on all of the texts; of too little text to train on, the text itself."""
    import zstandard

    raws = [t.encode() for t in texts]
    pieces = [p for r in raws for i in range(0, len(r), PIECE_BYTES) if len(p := r[i : i + PIECE_BYTES]) >= 16]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, k=256, d=8, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(raws)[-DICTIONARY_BYTES:] or b"0123456789"


def train(rows: list[tuple[str, int]]) -> Model:
    """Fit on (text, label) rows: the score is fitted on each fold with dictionaries of the other folds; the
    dictionaries used then are of all rows.

    Without at least two rows of each label the score says how common label 1 is (a half without rows).
    """
    parts = {y: [t or "" for t, label in rows if int(label) == y] for y in (0, 1)}
    model = Model(dictionary(parts[1]), dictionary(parts[0]), 0.0, 0.0, 1.0)
    if min(len(parts[0]), len(parts[1])) < 2:
        share = (len(parts[1]) + 1) / (len(rows) + 2)
        model.offset = float(np.log(share / (1 - share)))
        return model
    folds = min(FOLDS, len(parts[0]), len(parts[1]))
    x, labels = [], []
    for fold in range(folds):
        others = {y: [t for i, t in enumerate(parts[y]) if i % folds != fold] for y in (0, 1)}
        sizes = Compressors(dictionary(others[1]), dictionary(others[0]))
        for y in (0, 1):
            x += [sizes.difference(t) for t in parts[y][fold::folds]]
            labels += [y] * len(parts[y][fold::folds])
    model.scale = float(np.median(np.abs(x))) / 3 or 1.0
    slope, offset = fit_logistic(model.bent(np.array(x))[:, None], np.array(labels, float))
    model.slope, model.offset = float(slope), float(offset)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, limit_bytes: int = TRAIN_BYTES) -> list[tuple[str, int]]:
    """The bounded sample: rows of labels with quality 0 or 1 whose bucket is not 2, up to ``limit`` of each
    label, in the order of a hash, and whole texts of these up to ``limit_bytes`` of each label.

    The ids are chosen from labels alone; only their texts are then read to the driver.  An id with both
    labels is in both samples, of an id with several texts the least one.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), 4) != 2))
    order = F.crc32(F.concat_ws("/", F.col("doc_id").cast("string"), F.lit("q")).cast("binary"))
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("quality") == y).dropDuplicates(["doc_id"]).select("doc_id", "quality", order.alias("place")).orderBy("place", "doc_id").limit(limit)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    picked = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "place").agg(F.min("text").alias("text"))
    # At most 2 * limit rows: those that fit together, in order.
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("quality").orderBy("place", "doc_id"))
    rows = picked.withColumn("bytes", so_far).filter(F.col("bytes") <= limit_bytes).select("text", "quality", "place", "doc_id").collect()
    return [(r.text, r.quality) for r in sorted(rows, key=lambda r: (r.place, r.doc_id, r.quality))]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: the chance that a text is of label 1.  Null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        m = shared.value
        sizes = Compressors(m.good, m.bad)
        for batch in batches:
            x = np.array([sizes.difference(t.as_py() or "") for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCORED)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, in any number of copies.

    Scores depend on the text alone.  A null doc_id is never trained on and is not held out.
    """
    out = scored(docs, train(training_rows(docs, labels)))
    held = F.coalesce(bucket_of(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = REJECT) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(train(training_rows(docs, labels)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        m = shared.value
        sizes = Compressors(m.good, m.bad)
        for batch in batches:
            x = np.array([sizes.difference(t.as_py() or "") for t in batch.column(at)])
            yield batch.filter(pa.array(m.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their quality scores."""
    return classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
