"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one, so the largest cosine is the smallest
Euclidean distance. Each of TABLES tables hashes a vector by HASHES Gaussian
projections cut at WIDTH. A query visits its own bucket and PROBES - 1 perturbed
ones in order of estimated success (the sum of squared distances to the
boundaries crossed). Candidates of all tables are merged and reranked by their
exact cosine.

All rows are packed into chunks and the queries into blocks, both of bounded
size; each block meets each chunk once, where buckets are matched, and keeps
its best per task. So neither a crowded bucket nor a vector repeated in a third
of all rows makes rows: only the best few per query leave a task. A query for
which too few candidates were found is compared with all rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

TABLES, HASHES, WIDTH, PROBES, SEED = 32, 10, 2.0, 80, 7
#: Rows of a chunk, queries of a block, chunks that one group has at most.
CHUNK, BLOCK, GROUP = 2048, 1024, 128
#: Pairs that get their exact score at once.
PAIRS = 1 << 18
#: Below one candidate in so many pairs a chunk's products are made one by one;
#: a product in a matrix costs about that much less.
SPARSE = 16
SLACK = 1e-9


class Hashes:
    def __init__(self, dim: int):
        rng = np.random.default_rng(SEED)
        self.a = rng.normal(size=(TABLES, dim, HASHES))
        self.b = rng.uniform(0, WIDTH, size=(TABLES, 1, HASHES))
        self.mix = rng.integers(1, 2**62, HASHES) * 2 + 1
        steps = [d for d in itertools.product((-1, 0, 1), repeat=HASHES) if sum(map(abs, d)) <= 4]
        self.steps = np.array(steps, np.int64)

    def place(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        at = (unit @ self.a[table] + self.b[table]) / WIDTH
        low = np.floor(at)
        return low.astype(np.int64), at - low

    def keys(self, unit: np.ndarray, table: int) -> np.ndarray:
        return self.place(unit, table)[0] @ self.mix

    def probes(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Bucket keys per query, (queries, PROBES), most promising first."""
        cell, frac = self.place(unit, table)
        cost = (1 - frac) ** 2 @ (self.steps == 1).T.astype(float) + frac**2 @ (self.steps == -1).T.astype(float)
        best = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
        return (cell @ self.mix)[:, None] + (self.steps @ self.mix)[best]


def _unpack(ids: bytes, vecs: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(vecs, kind).reshape(len(i), -1).astype(float)


def _packed(rows: int, kind: str):
    """Rows (id, v, g) sorted by g into packed rows (g, ids, vecs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, rows):
                part = b.slice(s, rows)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind)
                i = part.column("id").to_numpy(zero_copy_only=False).astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([int(i[0])]), pa.array([i.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["at", "ids", "vecs"])

    return run


def _distinct(ids: np.ndarray, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by id, those that repeat both id and vector once, and where each id starts."""
    o = np.argsort(ids, kind="stable")
    ids, vecs = ids[o], vecs[o]
    if (ids[1:] == ids[:-1]).any():
        _, o = np.unique(np.column_stack([ids.view(float), vecs]).view(f"V{8 + 8 * vecs.shape[1]}").ravel(), return_index=True)
        o.sort()
        ids, vecs = ids[o], vecs[o]
    return ids, vecs, np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))


def _best(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best per query: larger score, then smaller id; an id once, with its best score."""
    o = np.lexsort((-s, c, q))
    q, c, s = q[o], c[o], s[o]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
    q, c, s = q[new], c[new], s[new]
    o = np.lexsort((c, -s, q))
    q, c, s = q[o], c[o], s[o]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], c[keep], s[keep]


def _search(k: int, exact: bool, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, hashes, best = None, None, None

        def flush() -> pa.RecordBatch:
            q, c, s = best
            return pa.RecordBatch.from_arrays([pa.array(qid[q]), pa.array(c), pa.array(s)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["q_at"] != block:
                    if best is not None and len(best[0]):
                        yield flush()
                    block = r["q_at"]
                    qid, qv = _unpack(r["q_ids"], r["q_vecs"], kind)
                    qn = np.linalg.norm(qv, axis=1)
                    qu = qv / qn[:, None]
                    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                    if not exact:
                        hashes = hashes or Hashes(qv.shape[1])
                        probes = []
                        for t in range(TABLES):
                            p = hashes.probes(qu, t)
                            o = np.argsort(p, axis=None, kind="stable")
                            probes.append((p.ravel()[o], (o // p.shape[1]).astype(np.int32)))
                cid, cv, starts = _distinct(*_unpack(r["ids"], r["vecs"], kind))
                cn = np.linalg.norm(cv, axis=1)
                cu = cv / cn[:, None]
                if exact:
                    found = np.ones((len(cid), len(qid)), bool)
                else:
                    found = np.zeros((len(cid), len(qid)), bool)
                    for t, (key, owner) in enumerate(probes):
                        own = hashes.keys(cu, t)
                        lo, n = (a := np.searchsorted(key, own)), np.searchsorted(key, own, "right") - a
                        row = np.repeat(np.arange(len(own)), n)
                        col = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                        found[row, owner[col]] = True
                found &= cid[:, None] != qid[None]
                if np.count_nonzero(found) * SPARSE < found.size:  # few candidates: only their products are made
                    near, at = np.full(found.shape, -2.0), np.nonzero(found)
                    for s in range(0, len(at[0]), PAIRS):
                        c, q = at[0][s : s + PAIRS], at[1][s : s + PAIRS]
                        near[c, q] = np.einsum("ij,ij->i", cu[c], qu[q])
                else:
                    near = np.where(found, cu @ qu.T, -2.0)
                # All that may be among the k best ids, ties included; these get the exact score.
                top = np.maximum.reduceat(near, starts, axis=0)
                kth = np.partition(top, len(top) - k, axis=0)[len(top) - k] if len(top) > k else np.full(len(qid), -2.0)
                least = np.repeat(np.maximum(top, kth[None]), np.diff(np.append(starts, len(cid))), axis=0) - SLACK
                ci, qi = np.nonzero(found & (near >= least))
                for at in range(0, len(ci), PAIRS):
                    c, q = ci[at : at + PAIRS], qi[at : at + PAIRS]
                    score = (cv[c] * qv[q]).sum(1) / (cn[c] * qn[q])
                    best = _best(np.concatenate([best[0], q]), np.concatenate([best[1], cid[c]]), np.concatenate([best[2], score]), k)
        if best is not None and len(best[0]):
            yield flush()

    return run


def _met(blocks: DataFrame, chunks: DataFrame, groups: int, k: int, exact: bool, kind: str) -> DataFrame:
    """The k best per query. Query blocks are laid out once per group of
    chunks, and met there by an equality join."""
    laid = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.col("at").alias("q_at"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    grouped = chunks.withColumn("g", F.pmod(F.xxhash64("at"), F.lit(groups)).cast("int"))
    met = grouped.join(laid.hint("merge"), "g").sortWithinPartitions("q_at")
    found = met.mapInArrow(_search(k, exact, kind), "query_id long, vec_id long, score double")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found.

    Both tables have vec_id and embedding. Null, zero and non-finite vectors
    and those of another than the most frequent length take no part. A query's
    own vec_id is no candidate. Rows that repeat a vec_id count once per
    candidate, with their best score; repeated queries are one query. Vectors
    of doubles are kept as doubles. Ties go to the smaller vec_id; an empty
    table, or no query, gives no rows; other columns are ignored."""
    wide = vectors.schema["embedding"].dataType.elementType.typeName() == "double"
    kind, array = ("<f8", "array<double>") if wide else ("<f4", "array<float>")

    def valid(df: DataFrame) -> DataFrame:
        v = F.col("embedding")
        df = df.select(F.col("vec_id").cast("long").alias("id"), v.cast(array).alias("v"))
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        return df.where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))

    rows, asked = valid(vectors), valid(queries).groupBy("id").agg(F.min("v").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    spark = vectors.sparkSession
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes["d"], sizes["count"]
    packed = "at long, ids binary, vecs binary"
    chunks = written(rows.where(F.size("v") == dim).mapInArrow(_packed(CHUNK, kind), packed), "ann-chunks")
    asked = written(asked.where(F.size("v") == dim), "ann-queries")
    groups = max(12, spark.sparkContext.defaultParallelism, -(-n // (CHUNK * GROUP)))
    found = written(_met(asked.mapInArrow(_packed(BLOCK, kind), packed), chunks, groups, k, False, kind), "ann-found")
    got = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("got"))
    short = written(asked.join(got, "id", "left").where(F.coalesce("got", F.lit(0)) < min(k, n - 1)).select("id", "v"), "ann-short")
    if short.isEmpty():
        return found
    rest = _met(short.mapInArrow(_packed(BLOCK, kind), packed), chunks, groups, k, True, kind)
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
