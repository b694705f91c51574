"""Quality by nearest-neighbour voting among latent-semantic vectors.

A text's terms are its byte pairs (hashed into BUCKETS, tf-idf, length one) and
STYLE terms: bins of repetition, symbols, capitals and marks. Latent vectors are
the terms projected on the leading singular vectors of a bounded sample of
labelled texts. The sample's vectors are broadcast; every document gets exact
cosines with all of them, in blocks, and its NEIGHBOURS nearest vote with
their label, weighted by similarity and by how thinly their class was sampled.
Of equally near ones (to EQUAL decimals) those of smaller doc_id vote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

BUCKETS, DIMS, NEIGHBOURS, BLOCK = 2048, 48, 25, 256
#: Labelled texts per class that are sampled, by hash order of doc_id: a bound
#: on what the driver gets (rows of 4 * (BUCKETS + STYLE) bytes) and broadcasts.
SAMPLE = 1200
CUT, POWER, EQUAL = 0.3, 8.0, 9
EDGES = {"repeat": (0.001, 0.05, 0.2, 0.5), "same": (0.02, 0.1, 0.3), "symbol": (0.001, 0.01, 0.03, 0.1), "upper": (0.08, 0.2, 0.5), "mark": (0.01, 0.1, 0.4)}
STYLE = sum(len(e) + 1 for e in EDGES.values())
STYLE_WEIGHT = 0.6
_CODES = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def terms(text: str) -> np.ndarray:
    """Raw term vector: counts of byte pairs, then style bins."""
    data = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(data, np.uint8)
    out = np.zeros(BUCKETS + STYLE, np.float32)
    if len(b) > 1:
        out[:BUCKETS] = np.bincount(_CODES[(b[:-1].astype(np.int64) << 8) | b[1:]], minlength=BUCKETS)
    words = data.split()
    n = max(1, len(words))
    h = np.fromiter(map(hash, words), np.int64, len(words))
    repeat = 0.0
    if len(h) > 5:
        grams = h[:-4] * 3 + h[1:-3] * 5 + h[2:-2] * 7 + h[3:-1] * 11 + h[4:] * 13
        repeat = 1 - len(np.unique(grams)) / len(grams)
    hist = np.bincount(b, minlength=256) if len(b) else np.zeros(256, np.int64)
    size = max(1, len(b))
    rates = {
        "repeat": repeat, "same": float((h[1:] == h[:-1]).mean()) if len(h) > 1 else 0.0, "symbol": hist[list(b"#*$%&|<>")].sum() / size,
        "upper": hist[65:91].sum() / size, "mark": hist[list(b"!?")].sum() / n,
    }
    at = BUCKETS
    for k, edges in EDGES.items():
        out[at + int(np.searchsorted(edges, rates[k]))] = 1.0
        at += len(edges) + 1
    return out


def _weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    pairs = np.log1p(x[:, :BUCKETS]) * idf
    pairs /= np.maximum(1e-9, np.linalg.norm(pairs, axis=1, keepdims=True))
    return np.hstack([pairs, STYLE_WEIGHT * x[:, BUCKETS:]])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))


class Model:
    """Projection, labelled vectors, labels and votes. score() is the share
    of the weighted votes for label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, sizes: tuple[int, int]):
        df = (x[:, :BUCKETS] > 0).sum(0)
        self.idf = np.log((1 + len(x)) / (1 + df)).astype(np.float32) + 1
        w = _weighted(x, self.idf)
        self.mean = w.mean(0)
        w = w - self.mean
        values, vectors = np.linalg.eigh(w.T @ w)
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :DIMS]).astype(float)
        self.vectors, self.y = _unit(w @ self.basis), y.astype(float)
        share = np.array([sizes[k] / max(1, (y == k).sum()) for k in (0, 1)])
        self.weight = np.where(y == 1, share[1], share[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        v = _unit((_weighted(x, self.idf) - self.mean) @ self.basis)
        # In double precision a product hardly depends on the batch; what is left is rounded away.
        cos = np.round(v @ self.vectors.T, EQUAL)
        k = min(NEIGHBOURS, cos.shape[1])
        kth = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k, None]
        above, same = cos > kth, cos == kth
        same &= np.cumsum(same, axis=1) <= k - above.sum(1)[:, None]  # the labelled are in order of doc_id
        near = np.nonzero(above | same)[1].reshape(-1, k)
        vote = np.maximum(1e-6, np.take_along_axis(cos, near, 1)) ** POWER * self.weight[near]
        return (vote * self.y[near]).sum(1) / vote.sum(1)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [terms(t.as_py()).astype("<f4").tobytes() for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(rows, pa.binary())], ["doc_id", "quality", "terms"])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of the labelled rows that are not held out; None if no
    label is given. Conflicting labels of one document count as 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if not sizes:
        return None
    picks = [known.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    picked = F.broadcast(picks[0].unionAll(picks[1]))  # 2 * sample rows
    rows = documents(docs).join(picked, "doc_id").mapInArrow(_terms, "doc_id long, quality int, terms binary")
    got = rows.groupBy("doc_id").agg(F.min(F.struct("quality", "terms")).alias("r")).orderBy("doc_id").limit(2 * sample).select("r.*").collect()
    if not got:
        return None
    x = np.stack([np.frombuffer(r["terms"], "<f4") for r in got])
    return Model(x, np.array([r["quality"] for r in got]), (sizes.get(0, 0), sizes.get(1, 0)))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted. Without any
    usable label every score is 0.5. Null and empty texts are scored by their
    style alone; texts may be of any length. Repeated rows get equal scores; an
    empty table has none."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, BLOCK):
                part = b.slice(s, BLOCK)
                if model.value is None:
                    out = np.full(part.num_rows, 0.5)
                else:
                    out = model.value.score(np.stack([terms(t.as_py()) for t in part.column("text")]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.clip(out, 0.0, 1.0))], ["doc_id", "score"])

    rows = documents(docs).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).cast("int").alias("predicted"))
