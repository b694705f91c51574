"""Packing of token sequences by non-negative least squares.

Each document is tokenised, ended by one id, and cut into full windows and a
rest. The histogram of rest lengths (under 2048 bins, whatever the corpus) is
matched by shallow combinations of two or three lengths that fill a window:
repeat counts come from non-negative least squares against the histogram, are
rounded and made to fit; what they leave of the histogram gets combinations of
its own, for a few rounds. What is left then is packed greedily in order of
length, cut where a window is full. Its last part-window is dealt into powers of
two, which need no padding, by subset sums, so that rests are cut there only
where no choice of them fills a power exactly.

Only the histogram and the combinations reach the driver. A rest's place
follows from its rank among rests of its length, which is its rank in its own
partition plus an offset per partition.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, process_cache, sized, written

WINDOW, END = 2048, 1
#: Combinations of three lengths tried a round, of so many most frequent
#: lengths; rounds at most; share of what is left that a round must place to be
#: followed by another.
TRIPLES, FREQUENT, ROUNDS, WORTH = 4096, 512, 8, 0.05
_LATIN = [chr(c) for c in range(0xA1, 0x250)]
_CAT = {k: "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == k) for k in "LN"}
# Texts of these characters only are split by the pattern below, which there
# equals the tokenizer's own; others go to the tokenizer whole.
_PLAIN = re.compile("[\\t\\n\\r -~\xa1-ųŵ-ɏ]*")
_PIECE = re.compile(f"[A-Za-z{_CAT['L']}]+|[0-9{_CAT['N']}]|'s|'t|'re|'ve|'m|'ll|'d|[^\\sA-Za-z{_CAT['L']}0-9{_CAT['N']}]+")
#: Pieces whose ids a worker remembers; beyond that it starts anew.
MEMORY = 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """ids of texts, as the tokenizers library gives them with
    add_special_tokens=False, as little-endian unsigned 32-bit bytes. No merge
    crosses white space, so each run of other characters is encoded once and
    remembered. A text in which an added token is spelled out goes to the
    library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.model = Tokenizer.from_file(path)
        added = {t.content.lower() for t in self.model.get_added_tokens_decoder().values()}
        self.added = re.compile("|".join(map(re.escape, sorted(added)))) if added else None
        self.split = '"pattern":{"Regex":"\'s|\'t|\'re|\'ve|\'m|\'ll|\'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+"}' in self.model.to_str()
        level, merge = ByteLevel(add_prefix_space=False, use_regex=False), self.model.model.tokenize
        plain, pieces = re.compile("[!-~]*").fullmatch, _PIECE.findall

        class Words(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= MEMORY:
                    self.clear()
                got = self[piece] = array("I", [t.id for t in merge(piece if plain(piece) else level.pre_tokenize_str(piece)[0][0])]).tobytes()
                return got

        class Known(dict):
            def __missing__(self, chunk: str) -> bytes:
                if len(self) >= MEMORY:
                    self.clear()
                got = self[chunk] = b"".join([word[p] for p in pieces(chunk)])
                return got

        word, self.known = Words(), Known()

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.split or not _PLAIN.fullmatch(text):
            return self.whole(text)
        low = text.lower()
        if self.added is not None and self.added.search(low):
            return self.whole(text)
        return b"".join(map(self.known.__getitem__, low.split()))


def _tokenised(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, part = process_cache("tokenizer"), TaskContext.get().partitionId()
        encode = cache.get(path) or cache.setdefault(path, Encoder(path))
        seen, full = [0] * WINDOW, 0
        for b in batches:
            for s in range(0, b.num_rows, 256):
                own = b.slice(s, 256)
                out: dict[str, list] = {k: [] for k in ("n", "rest", "k", "full", "ids")}
                for text in own.column("text"):
                    ids = encode(text.as_py()) + END.to_bytes(4, "little")
                    n = len(ids) // 4
                    r = n % WINDOW
                    for key, v in zip(out, (n, r, seen[r], full, ids), strict=True):
                        out[key].append(v)
                    seen[r] += 1
                    full += n // WINDOW
                ids = np.frombuffer(b"".join(out["ids"]), "<u4").astype("<u2") if max(map(len, out["ids"])) and _small(out["ids"]) else None
                packed = out["ids"] if ids is None else [x.tobytes() for x in np.split(ids, np.cumsum(out["n"])[:-1])]
                cols = [own.column("doc_id"), pa.array([part] * len(packed), pa.int32()), pa.array(out["full"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["rest"], pa.int32()), pa.array(out["k"], pa.int64()), pa.array([2 if ids is not None else 4] * len(packed), pa.int32()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "part", "full", "n", "rest", "k", "width", "ids"])

    return run


def _small(ids: list[bytes]) -> bool:
    return not np.frombuffer(b"".join(ids), "<u2")[1::2].any()


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row: doc_id, part, full windows of the part's rows before it, n ids
    with the end, rest = n % WINDOW, k its rank among rests of this length in
    the part."""
    return documents(docs).mapInArrow(_tokenised(tokenizer), "doc_id long, part int, full long, n long, rest int, k long, width int, ids binary")


def combinations(counts: np.ndarray) -> list[tuple[int, ...]]:
    """Shallow combinations of lengths that fill a window: all pairs, and
    triples of the most frequent lengths."""
    have = np.flatnonzero(counts)
    have = have[have > 0]
    out = [(int(a), WINDOW - int(a)) for a in have if 2 * a <= WINDOW and counts[WINDOW - a]]
    top = sorted(have[np.argsort(-counts[have], kind="stable")][:FREQUENT].tolist())
    triples = [(a, b, WINDOW - a - b) for a, b in itertools.combinations_with_replacement(top, 2) if WINDOW - a - b >= b and counts[WINDOW - a - b]]
    # Those with more than half a window first: it is the long rests that are hard to place.
    triples.sort(key=lambda t: (2 * t[2] <= WINDOW, -min(counts[x] for x in t), t))
    return out + triples[:TRIPLES]


def repeats(counts: np.ndarray, combos: list[tuple[int, ...]], sweeps: int = 200) -> np.ndarray:
    """Whole repeat counts: non-negative least squares of the combinations'
    lengths against the histogram by coordinate descent, rounded up, largest
    first, and held to what the histogram has left."""
    left = counts.astype(float)
    x = np.zeros(len(combos))
    uses = [tuple((v, c.count(v)) for v in dict.fromkeys(c)) for c in combos]
    for _ in range(sweeps):
        moved = 0.0
        for i, u in enumerate(uses):
            step = sum(m * left[v] for v, m in u) / sum(m * m for _, m in u)
            if (new := max(0.0, x[i] + step)) != x[i]:
                for v, m in u:
                    left[v] -= m * (new - x[i])
                moved = max(moved, abs(new - x[i]))
                x[i] = new
        if moved < 0.25:
            break
    out, have = np.zeros(len(combos), np.int64), counts.astype(np.int64).copy()
    for i in np.argsort(-x, kind="stable"):
        n = min(math.ceil(x[i] - 1e-9), *(int(have[v]) // m for v, m in uses[i]))
        out[i] = n
        for v, m in uses[i]:
            have[v] -= n * m
    return out


def subset(lengths: list[int], total: int) -> list[int] | None:
    """Indexes of lengths that add up to total, if any do: sums within reach
    of the first so many lengths are the bits of a number each."""
    mask, reach = (1 << total + 1) - 1, [1]
    for v in lengths:
        reach.append((reach[-1] | reach[-1] << v) & mask)
    if not reach[-1] >> total & 1:
        return None
    out = []
    for i in range(len(lengths) - 1, -1, -1):
        if not reach[i] >> total & 1:
            out.append(i)
            total -= lengths[i]
    return out


def tail(lengths: list[int], begun: int) -> list[int]:
    """The rests of the last part-window in an order that cuts few of them.
    begun: ids in it already, of a rest cut by the window before."""
    total, left, out = begun + sum(lengths), sorted(lengths, reverse=True), []
    at, border = begun, 0
    for bit in range(WINDOW.bit_length() - 2, -1, -1):
        if total >> bit & 1:
            border += 1 << bit
            if at < border and (found := subset(left, border - at)) is not None:
                out += [left[i] for i in found]
                left = [v for i, v in enumerate(left) if i not in set(found)]
                at = border
            while at < border:  # none fits: the largest that does, at last one that is cut
                i = next((i for i, v in enumerate(left) if at + v <= border), len(left) - 1)
                at += left[i]
                out.append(left.pop(i))
    return out


def plan(counts: np.ndarray) -> tuple[list[tuple[int, int, int, int, int, int]], int, int]:
    """Where rests go, by length and rank: rows (length, first rank, one past
    the last, first sequence or for residuals -1, offset or for residuals the
    first position, step), sequences used, and residual ids in total."""
    used, rows, seq = np.zeros(WINDOW, np.int64), [], 0
    sizes = np.arange(WINDOW)
    for _ in range(ROUNDS):
        left = counts - used
        combos = combinations(left)
        times = repeats(left, combos) if combos else np.zeros(0, np.int64)
        for c, n in zip(combos, times.tolist(), strict=True):
            if n:
                at = 0
                for v in c:
                    rows.append((v, int(used[v]), int(used[v]) + n, seq, at, 1))
                    used[v] += n
                    at += v
                seq += n
        if int(times.sum()) * WINDOW <= WORTH * int((left * sizes).sum()):
            break
    left = counts - used
    residual = int((left * sizes).sum())
    whole, at = residual // WINDOW * WINDOW, 0
    rest: list[int] = []

    def place(v: int, n: int) -> None:
        nonlocal at
        rows.append((v, int(used[v]), int(used[v]) + n, -1, at, v))
        used[v] += n
        at += n * v

    for v in range(WINDOW - 1, 0, -1):
        if n := int(left[v]):
            first = min(n, max(0, -(-(whole - at) // v)))  # those that begin before the last part-window
            rest += [v] * (n - first)
            if first:
                place(v, first)
    for v, same in itertools.groupby(tail(rest, at - whole)):
        place(v, len(list(same)))
    return rows, seq, residual


def _pieces(full: int, residual_seq: int, residual: int):
    """Cuts rows into pieces. Sequences: rests by combination first, then
    residuals from residual_seq, then full windows from full on."""
    whole = residual // WINDOW * WINDOW
    ends, at = [], whole
    for bit in range(WINDOW.bit_length() - 2, -1, -1):  # the last part-window, by powers of two
        if residual - whole >> bit & 1:
            ends.append((at, at + (1 << bit), residual_seq + whole // WINDOW + len(ends)))
            at += 1 << bit

    def cut(at: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """start in the rest, length, sequence, offset"""
        begin, stop = at, at + length
        while at < stop:
            if at < whole:
                a, b, seq = at // WINDOW * WINDOW, (at // WINDOW + 1) * WINDOW, residual_seq + at // WINDOW
            else:
                a, b, seq = next(e for e in ends if at < e[1])
            n = min(b, stop) - at
            yield at - begin, n, seq, at - a
            at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        for b in batches:
            for s in range(0, b.num_rows, 512):
                out: list[tuple] = []
                for r in b.slice(s, 512).to_pylist():
                    ids, n, w = r["ids"], r["n"], r["width"]
                    got = [(i * WINDOW, WINDOW, full + r["first_full"] + i, 0) for i in range(n // WINDOW)]
                    if base := r["rest"]:
                        j, first = r["rank"] - r["lo"], n - base
                        got += [(first, base, r["seq"] + j, r["at"])] if r["seq"] >= 0 else [(first + a, m, q, o) for a, m, q, o in cut(r["at"] + j * r["step"], base)]
                    for start, m, q, o in got:
                        part = ids[start * w : (start + m) * w]
                        out.append((r["doc_id"], start, m, n, q, o, part if w == 4 else np.frombuffer(part, "<u2").astype("<u4").tobytes()))
                cols = list(zip(*out, strict=True)) if out else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, cols, strict=True)], names)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, doc_tokens,
    sequence_id, offset, ids (binary, little-endian unsigned 32-bit).

    Every id of every row is in exactly one piece; a null or empty text has
    the end id alone; repeated rows are packed once each. A text may have any
    number of windows: sequences are numbered by prefix sums of windows, so no
    two documents share a number they should not. Rests of one length are
    placed in the order of partitions and rows; an empty table has no pieces."""
    spark = docs.sparkSession
    rows = written(tokenised(docs, tokenizer or default_tokenizer()), "packing-ids")
    per = rows.groupBy("part", "rest").agg(F.count("*").alias("c"), F.sum(F.floor(F.col("n") / WINDOW)).alias("f"))
    per = written(per, "packing-counts")
    hist = np.zeros(WINDOW, np.int64)
    for r in per.groupBy("rest").agg(F.sum("c").alias("c")).collect():
        hist[r["rest"]] = r["c"]
    places, seqs, residual = plan(hist)
    residual_seqs = -(-residual // WINDOW) + 16
    by_rest = Window.partitionBy("rest").orderBy("part")
    offsets = per.select("part", "rest", (F.sum("c").over(by_rest) - F.col("c")).alias("before"))
    # One row per task that tokenised: small enough to be summed up in one.
    parts = per.groupBy("part").agg(F.sum("f").alias("f"))
    parts = parts.select("part", (F.sum("f").over(Window.orderBy("part")) - F.col("f")).alias("fulls"))
    offsets = offsets.join(parts, "part")
    n_parts = per.agg(F.count("*").alias("n")).first()["n"]
    rows = rows.join(sized(offsets, n_parts, 40), ["part", "rest"])
    rows = rows.withColumn("rank", F.col("before") + F.col("k"))
    rows = rows.withColumn("first_full", F.col("fulls") + F.col("full"))
    table = spark.createDataFrame(places or [(0, 0, 0, 0, 0, 0)], "rest int, lo long, hi long, seq long, at long, step long")
    lists = table.groupBy("rest").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "seq", "at", "step"))).alias("ps"))
    rows = rows.join(F.broadcast(lists), "rest", "left")  # at most ROUNDS * (3 * TRIPLES + WINDOW) + 2 * WINDOW entries
    rows = rows.withColumn("p", F.element_at(F.filter("ps", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"])), 1)).select("doc_id", "n", "rest", "rank", "width", "ids", "first_full", "p.lo", "p.seq", "p.at", "p.step")
    return rows.mapInArrow(_pieces(seqs + residual_seqs, seqs, residual), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns: ids as their crc32."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
