"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of ORDERS code points (A-Z lower-cased), hashed to BUCKETS, by the logarithm of one plus how often
they stand in the text. The ratio of a
feature is the logarithm of the smoothed share of toxic training texts that hold it over that of the others; features
are multiplied by their ratio and a logistic regression is fitted on them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.cluster import ship

ORDERS = (3, 4, 5)
BUCKETS = 1 << 20
#: The sample to learn from: at most so many texts of each label (those with the smallest hash of doc_id), and so many bytes
#: of text in all. The size of the model: so many features.
TRAIN_A_LABEL, TRAIN_BYTES, FEATURES = 3000, 64 << 20, 2048
LEAST_DOCS, SMOOTHING, L2, STEPS = 3, 1.0, 1e-2, 400
THRESHOLD = 0.3
HELD_OUT = "pmod(crc32(cast(doc_id as string)), 4) = 2"
_SLICE = 1 << 19
_M = np.uint64(0x9E3779B97F4A7C15)


def _points(texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, folded code points of the texts one after another, where each begins and, last, ends), by slices."""
    texts = texts.fill_null("") if texts.null_count else texts
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    at, low = np.concatenate([[0], np.cumsum(sizes)]), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(at, at[low] + _SLICE, "right")) - 1)
        raw = "".join(texts.slice(low, high - low).to_pylist()).encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(raw, np.uint32)
        upper = (points >= 65) & (points <= 90)
        yield low, points + (upper * np.uint32(32)), at[low : high + 1] - at[low]
        low = high


def _buckets(points: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each position but the last ``order`` - 1."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, order, np.uint64)
    for k in range(order):
        h = (h + points[k : k + n]) * _M
        h ^= h >> np.uint64(29)
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def _grams(points: np.ndarray, at: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, features, how often): each feature of each text once. wanted: features by bucket, -1 where none."""
    texts, found = [], []
    for order in ORDERS:
        feature = _buckets(points, order)
        place = np.arange(len(feature))
        if wanted is not None:
            feature = wanted[feature]
            place = np.flatnonzero(feature >= 0)
            feature = feature[place]
        text = np.searchsorted(at, place, "right") - 1
        inside = place + order <= at[text + 1]
        texts.append(text[inside])
        found.append(feature[inside].astype(np.int64))
    both, often = np.unique(np.concatenate(texts) * BUCKETS + np.concatenate(found), return_counts=True)
    return both // BUCKETS, both % BUCKETS, often


def _value(often: np.ndarray) -> np.ndarray:
    return np.log2(1.0 + often)


@dataclass(frozen=True)
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts) -> np.ndarray:
        wanted = np.full(BUCKETS, -1, np.int32)
        wanted[self.features] = np.arange(len(self.features))
        out = np.full(len(texts), self.bias)
        for first, points, at in _points(texts):
            text, feature, often = _grams(points, at, wanted)
            out[first : first + len(at) - 1] += np.bincount(text, self.weights[feature] * _value(often), len(at) - 1)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit(texts: list[str | None], labels: list[int], shares: tuple[float, float]) -> Model:
    """shares: of the labels 0 and 1 among all rows that may be learned from, which the sample need not keep."""
    y = np.array(labels, np.float64)
    prior = min(max(shares[1], 1e-3), 1 - 1e-3)
    none = Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not len(y) or y.min() == y.max():
        return none
    column = pa.array(texts, pa.string())
    counts = np.zeros((2, BUCKETS), np.int64)
    for first, points, at in _points(column):
        text, bucket, often = _grams(points, at)
        for label in (0, 1):
            counts[label] += np.bincount(bucket[y[first + text] == label], minlength=BUCKETS)
    per = np.array([[max(1, (y == 0).sum())], [max(1, (y == 1).sum())]])
    p = (counts + SMOOTHING) / (per + 2 * SMOOTHING)
    ratio = np.log(p[1] / p[0])
    weigh = np.abs(p[1] - p[0]) / np.sqrt((p[0] * (1 - p[0]) / per[0]) + (p[1] * (1 - p[1]) / per[1]))
    weigh[counts.sum(0) < LEAST_DOCS] = 0
    chosen = np.sort(np.argsort(-weigh, kind="stable")[:FEATURES])
    chosen = chosen[weigh[chosen] > 0]
    if not len(chosen):
        return none
    wanted = np.full(BUCKETS, -1, np.int32)
    wanted[chosen] = np.arange(len(chosen))
    x = np.zeros((len(y), len(chosen)), np.float32)
    for first, points, at in _points(column):
        text, feature, often = _grams(points, at, wanted)
        x[first + text, feature] = ratio[chosen[feature]] * _value(often)
    w = _logistic(x, y, np.where(y == 1, prior / (y == 1).sum(), (1 - prior) / (y == 0).sum()), none.bias)
    return Model(chosen, w * ratio[chosen], none.bias)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    """Logistic regression by accelerated gradient steps; weights of the rows add up to one. The bias stays the log odds of
    the labels, so a text without any known n-gram gets their share."""
    step = 4 / (float((weight[:, None] * x * x).sum()) + 1)
    w = ahead = np.zeros(x.shape[1])
    for k in range(STEPS):
        error = weight * (1 / (1 + np.exp(-np.clip(x @ ahead.astype(np.float32) + bias, -60, 60))) - y)
        new = ahead - step * (x.T @ error.astype(np.float32) + L2 * ahead)
        ahead, w = new + k / (k + 3) * (new - w), new
    return w


def _smallest(known: DataFrame, most: int, total: int) -> list[int]:
    """The ``most`` doc_ids with the smallest hash. A bound of the hash that lets somewhat more pass keeps what tasks send small."""
    order = F.xxhash64("doc_id")
    share = (most + 8 * most**0.5 + 64) / max(total, 1)
    for bounded in (known.filter(order < F.lit(int((share - 0.5) * 2**64))), known) if share < 1 else (known,):
        found = [r["doc_id"] for r in bounded.orderBy(order, "doc_id").limit(most).collect()]
        if len(found) == min(most, total):
            break
    return found


def train(documents: DataFrame, labels: DataFrame, a_label: int = TRAIN_A_LABEL, most_bytes: int = TRAIN_BYTES) -> Model:
    """The model from labelled rows that are not held out, at most ``a_label`` of each label and ``most_bytes`` of text.

    A doc_id with several labels is toxic if one says so; of one with several texts, that with the smallest hash counts. Rows without a
    label, doc_id or text are left out. Labels are taken in turn, by hash, while their texts fit into ``most_bytes``.
    """
    known = labels.filter(f"doc_id is not null and toxic is not null and not ({HELD_OUT})")
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") >= 1, 1).otherwise(0)).alias("y"))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = max(1, sum(shares.values()))
    chosen = [(k, i, y) for y in (0, 1) for k, i in enumerate(_smallest(known.filter(F.col("y") == y).select("doc_id"), a_label, shares.get(y, 0)))]
    ids = known.sparkSession.createDataFrame([(k, int(i), y) for k, i, y in chosen], "place int, doc_id long, y int")
    # ids has 2 * a_label rows at most. Sizes come first, so that only texts that fit are sent.
    rows = documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(ids), "doc_id")
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    sizes = rows.groupBy("doc_id", "place", "y").agg(F.min(F.struct("_hash", F.octet_length("text").alias("n"))).alias("t")).select("doc_id", "place", "y", "t._hash", "t.n").collect()
    fits, held = [], 0
    for r in sorted(sizes, key=lambda r: (r["place"], r["y"])):
        if held + r["n"] <= most_bytes:
            held += r["n"]
            fits.append((r["doc_id"], r["_hash"]))
    wanted = F.broadcast(known.sparkSession.createDataFrame(fits, "doc_id long, _hash long"))
    # Of repeats, a row a task and then one; no more is sent than fits.
    texts = rows.join(wanted, ["doc_id", "_hash"]).groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    texts.sort(key=lambda r: r["doc_id"])
    return fit([r["text"] for r in texts], [r["y"] for r in texts], (shares.get(0, 0) / total, shares.get(1, 0) / total))


def _scorer(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            scores = pa.array(model.value.score(batch.column("text")), pa.float64())
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != at), scores], names=[*(n for n in batch.schema.names if n != "text"), "score"])

    return run


def score(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each input row, no shuffle of texts.

    ``score`` in [0, 1] depends on the text alone; null and empty texts get the score of a text without any known n-gram. Without
    labels, or with one label only, every text gets the (bounded) share of toxic labels. ``held_out``: crc32 of the
    doc_id as text, mod 4, is 2 (false for a null doc_id); such labels are never learned from. Repeated rows
    stay; an empty table gives no rows; other columns are ignored; texts are scored whole.
    """
    spark = documents.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(documents, labels))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "text")
    scored = rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_clean(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` without the rows whose score reaches ``threshold``; columns and other rows are unchanged."""
    spark = documents.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.value.score(batch.column("text")) < threshold))

    return documents.mapInArrow(run, documents.schema)
