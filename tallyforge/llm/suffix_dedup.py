"""Removal of repeated 100-byte strings by merging Burrows-Wheeler transforms.

Every window of LENGTH bytes is named by its anchor, the least hash of its
32-byte strings, a function of the window's content; so equal windows have equal
anchors. Successive windows of one anchor form a run. A run whose anchor is of
no other run, and stands in it once, repeats nothing. Of equal runs all but the first are repeats whole. What is
left, different runs of one anchor (the borders of repeats), is decided byte by
byte: the runs' bytes are sorted into shards, each shard's Burrows-Wheeler
transform is made, and the transforms of a group are merged by refining their
interleave by STEP bytes per step. A step moves each entry to the place of the
bytes before it, stably, so after k steps entries stand in order of their first
STEP * k bytes, and the borders between unequal ones are where the common prefix
is shorter. Entries alone in their interval are let go. After LENGTH bytes the
intervals are the repeated strings; all but the earliest
place of each are repeats. No suffix is sorted again across shards.

Groups of one anchor with more than HOT different runs, or HEAVY bytes in them,
would be too much for one task. Their runs are cut again by anchors of another
hash, of which equal windows have equal ones too, and dealt by these. What even
so is too much (periodic bytes, mostly) is decided by the windows' 128-bit
hashes, whose least place is found with partial aggregation. Runs are compared by a 64-bit hash beside the 64-bit anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

LENGTH, GRAM = 100, 32
WIDE = LENGTH - GRAM + 1
#: Bytes by which a step of the merge goes on; LENGTH is a multiple.
STEP = 2
#: Different runs of one anchor that one task merges (about 140 bytes each), and
#: bytes; bytes of a shard and of a group of shards; windows of a text read at
#: once, windows hashed at once.
HOT, HEAVY, SHARD, GROUP, BLOCK, HASHED = 16_384, 1 << 22, 1 << 19, 1 << 21, 1 << 20, 1 << 16
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
LAST = (1 << 63) - 1
SALT = 0x27D4EB2F165667C5


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= K2
    x ^= x >> np.uint64(32)
    return x


def _slid(h: np.ndarray, best) -> np.ndarray:
    """best of each WIDE successive values."""
    w = 1
    while 2 * w <= WIDE:
        h = best(h[:-w], h[w:])
        w *= 2
    return best(h[: len(h) - (WIDE - w)], h[WIDE - w :])


def anchors(data: bytes, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window of data (LENGTH bytes at least; another for
    another salt), and the anchors that stand at two places within a window's reach of each other,
    whose runs may repeat windows of their own."""
    n = len(data)
    h = _mix(np.ndarray((n - 7,), "<u8", data, strides=(1,)) * K1)
    h = _mix(h[:-8] * K3 + h[8:])
    h = _mix((h[:-16] ^ np.uint64(salt)) * K1 + h[16:])
    m = _slid(h, np.minimum)
    edge = np.zeros(WIDE - 1, np.uint64)
    at = np.flatnonzero(_slid(np.concatenate([edge, m, edge]), np.maximum) == h)  # where anchors stand
    o = np.lexsort((at, h[at]))
    v, at = h[at][o], at[o]
    return m, v[1:][(v[1:] == v[:-1]) & (at[1:] - at[:-1] <= WIDE)]


def runs(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, first window, one past the last, may repeat itself) arrays.
    A run ends at a block's border; that makes more runs, not other results."""
    for at in range(0, len(data) - LENGTH + 1, BLOCK):
        m, near = anchors(data[at : at + BLOCK + LENGTH - 1])
        s = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        own = np.isin(m[s], near) if len(near) else np.zeros(len(s), bool)
        yield m[s], s + at, np.append(s[1:], len(m)) + at, own


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    names = ["a", "h", "doc", "tie", "start", "n", "own"]
    for b in batches:
        cols: list[list] = [[] for _ in names]
        held = 0
        docs, ties = b.column("doc").to_numpy(), b.column("tie").to_numpy()
        for i, text in enumerate(b.column("text")):
            data = text.as_py().encode("utf-8", "surrogatepass")
            view = memoryview(data)
            for a, s, e, own in runs(data):
                h = np.fromiter((xxhash.xxh3_64_intdigest(view[p:q]) for p, q in zip(s.tolist(), (e + (LENGTH - 1)).tolist(), strict=True)), np.uint64, len(a))
                for c, v in zip(cols, (a.view(np.int64), h.view(np.int64), np.full(len(a), docs[i]), np.full(len(a), ties[i]), s.astype(np.int32), (e - s).astype(np.int32), own), strict=True):
                    c.append(v)
                held += len(a)
            if held > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names)
                cols, held = [[] for _ in names], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names)


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard of strings: its suffixes (places in the strings joined, each
    string with an end mark) in order of their first LENGTH bytes at least, the
    STEP bytes before each, and for each the rank of the suffix that starts
    STEP bytes before (-1 where its string begins later)."""
    raw = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
    ends = np.cumsum([len(s) + 1 for s in strings]) - 1
    n = len(raw)
    size = np.diff(ends, prepend=-1)
    left = np.repeat(ends, size) - np.arange(n)  # bytes up to the string's end
    text = raw.astype(np.uint64) + np.uint64(1)
    text[ends] = 0
    # Rank by seven bytes, then by doubling. An end mark ends what is compared.
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key <<= np.uint64(9)
        key[: n - k] |= np.where(left[: n - k] >= k, text[k:], np.uint64(0))
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (key[order][1:] != key[order][:-1]).astype(np.int64)]))
    width = 7
    while width < LENGTH and rank[order[-1]] < n - 1:
        pair = rank * (n + 1)
        pair[: n - width] += np.where(left[: n - width] >= width, rank[width:] + 1, 0)
        order = np.argsort(pair)
        rank[order] = np.cumsum(np.concatenate([[0], (pair[order][1:] != pair[order][:-1]).astype(np.int64)]))
        width *= 2
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    code = np.zeros(n, np.uint16)
    code[STEP:] = (raw[: n - STEP].astype(np.uint16) << 8) | raw[1 : n - STEP + 1]
    prior = np.full(n, -1, np.int32)
    prior[STEP:] = place[: n - STEP]
    prior[np.repeat(size - 1, size) - left < STEP] = -1
    return order, code[order], prior[order]


def merged(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of the transforms' entries that start a string of LENGTH bytes which
    occurs again: (entry, interval). Entries count through the shards."""
    starts = np.cumsum([0, *(len(s[0]) for s in shards)])
    before = np.concatenate([s[1] for s in shards])
    prior = np.concatenate([np.where(s[2] < 0, -1, s[2] + at) for s, at in zip(shards, starts, strict=False)]).astype(np.int32)
    entry = np.arange(starts[-1], dtype=np.int32)
    block = np.zeros(len(entry), np.int32)
    for done in range(STEP, LENGTH + 1, STEP):
        to = prior[entry]
        if (inside := to >= 0).all():
            c = before[entry]
        else:
            to, c, block = to[inside], before[entry[inside]], block[inside]
        o = np.argsort(c, kind="stable")  # a radix sort
        entry, block, c = to[o], block[o], c[o]
        new = np.empty(len(entry) + 1, bool)
        new[0] = new[-1] = True
        new[1:-1] = (c[1:] != c[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(new[:-1], dtype=np.int32)
        alone = new[:-1] & new[1:]
        if done == LENGTH or 8 * np.count_nonzero(alone) > len(alone):
            entry, block = entry[~alone], block[~alone]
    return entry, block


def repeats(rows: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int, int]]:
    """(doc, tie, start, end) of byte ranges that repeat an earlier string.
    rows: (doc, tie, start, bytes), any number of shards' worth."""
    rows = sorted(rows)
    shards, part, size = [], [], 0
    for r in rows:
        part.append(r[3])
        size += len(r[3]) + 1
        if size >= SHARD:
            shards.append(transform(part))
            part, size = [], 0
    if part:
        shards.append(transform(part))
    entry, block = merged(shards)
    if not len(entry):
        return []
    at = np.cumsum([0, *(len(s[0]) for s in shards)])
    places = np.concatenate([s[0] + a for s, a in zip(shards, at, strict=False)])[entry]
    # Places in all strings joined; rows are in order, but strings of one document may overlap.
    begin = np.cumsum([0, *(len(r[3]) + 1 for r in rows)])[:-1]
    row = np.searchsorted(begin, places, "right") - 1
    pos = np.array([r[2] for r in rows], np.int64)[row] + places - begin[row]
    same = np.zeros(len(rows), np.int64)
    for i in range(1, len(rows)):
        same[i] = same[i - 1] + (rows[i][:2] != rows[i - 1][:2])
    doc = same[row]
    o = np.lexsort((pos, doc, block))
    first = np.concatenate([[True], block[o][1:] != block[o][:-1]])
    group = np.cumsum(first) - 1
    lead = o[first][group]
    later = o[(doc[o] != doc[lead]) | (pos[o] != pos[lead])]
    later = later[np.lexsort((pos[later], doc[later]))]
    out = []
    if len(later):
        d, p = doc[later], pos[later]
        cut = np.concatenate([[0], np.flatnonzero((d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1)) + 1, [len(d)]])
        keys = {int(s): r[:2] for s, r in zip(same, rows, strict=True)}
        out = [(*keys[int(d[a])], int(p[a]), int(p[b - 1]) + LENGTH) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return out


def _ranges(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc", "tie", "start", "end"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; groups of whole anchors are merged."""
    held: list[tuple[int, int, int, bytes]] = []
    size, last = 0, None
    for b in batches:
        for a, *row in zip(*(b.column(k).to_pylist() for k in ("a", "doc", "tie", "start", "s")), strict=True):
            if a != last and size >= GROUP:
                yield _ranges(repeats(held))
                held, size = [], 0
            last = a
            held.append(tuple(row))
            size += len(row[3])
    if held:
        yield _ranges(repeats(held))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each document's runs that are to be merged."""
    names, types = ["a", "hot", "doc", "tie", "start", "s"], (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    for b in batches:
        out: list[tuple] = []
        size = 0
        for text, doc, tie, own in zip(b.column("text"), b.column("doc").to_pylist(), b.column("tie").to_pylist(), b.column("own"), strict=True):
            data = text.as_py().encode("utf-8", "surrogatepass")
            for r in own.as_py():
                s = data[r["start"] : r["start"] + r["n"] + LENGTH - 1]
                out.append((r["a"], r["hot"], doc, tie, r["start"], s))
                size += len(s)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def _recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hot runs cut by another anchor, mixed with the first."""
    for b in batches:
        for a, doc, tie, start, s in zip(*(b.column(k).to_pylist() for k in ("a", "doc", "tie", "start", "s")), strict=True):
            m, _ = anchors(s, SALT)
            cut = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1], [True]])).tolist()
            keys = _mix(m[cut[:-1]] * K3 + np.uint64(a % (1 << 64))).view(np.int64)
            parts = [s[p : q + LENGTH - 1] for p, q in zip(cut, cut[1:])]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([doc] * n, pa.int64()), pa.array([tie] * n, pa.int64()), pa.array([start + p for p in cut[:-1]], pa.int32()), pa.array(parts, pa.binary())], ["a", "doc", "tie", "start", "s"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the runs with its 128-bit hash."""
    import xxhash

    for b in batches:
        for doc, tie, start, s in zip(*(b.column(k).to_pylist() for k in ("doc", "tie", "start", "s")), strict=True):
            for at in range(0, len(s) - LENGTH + 1, HASHED):
                n = min(HASHED, len(s) - LENGTH + 1 - at)
                hs = [xxhash.xxh3_128_digest(s[i : i + LENGTH]) for i in range(at, at + n)]
                yield pa.RecordBatch.from_arrays([pa.array(hs, pa.binary()), pa.array([doc] * n, pa.int64()), pa.array([tie] * n, pa.int64()), pa.array(range(start + at, start + at + n), pa.int32())], ["w", "doc", "tie", "start"])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's byte ranges, overlapping and touching ones united, as pairs
    of 32-bit numbers."""
    for b in batches:
        out = []
        for own in b.column("own"):
            got: list[int] = []
            for s, e in sorted((r["start"], r["end"]) for r in own.as_py()):
                if got and s <= got[-1]:
                    got[-1] = max(got[-1], e)
                else:
                    got += [s, e]
            out.append(np.array(got, "<i4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("tie"), pa.array(out, pa.binary())], ["doc", "tie", "gone"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[] for _ in range(5)]
        for text, gone in zip(b.column("text"), b.column("gone"), strict=True):
            data = text.as_py().encode("utf-8", "surrogatepass")
            cuts = np.frombuffer(gone.as_py() or b"", "<i4").reshape(-1, 2).tolist()
            rest, at = [], 0
            for s, e in cuts:
                rest.append(data[at:s])
                at = e
            kept = b"".join([*rest, data[at:]])
            for o, v in zip(out, (len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                o.append(v)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def ranges(docs: DataFrame) -> DataFrame:
    """doc, tie, gone: the united byte ranges to remove, for documents that
    have any. docs: doc (order), tie (order among equal doc), text."""
    place = F.struct("doc", "tie", "start")
    rows = written(docs.mapInArrow(_runs, "a long, h long, doc long, tie long, start int, n int, own boolean"), "suffix-runs")
    often = written(rows.groupBy("a").agg(F.count("*").alias("c"), F.max("own").alias("own")).where("c > 1 or own").select("a"), "suffix-anchors")
    # As many anchors as a share of the input: always a shuffled join, which splits a hot anchor's runs.
    again = written(rows.join(often.hint("merge"), "a", "left_semi"), "suffix-candidates")
    discard(rows, often)
    firsts = written(again.groupBy("a", "h").agg(F.min(F.struct("doc", "tie", "start", "n")).alias("f"), F.count("*").alias("c"), F.max("own").alias("own")), "suffix-firsts")
    more = firsts.where("c > 1").select("a", "h", F.struct("f.doc", "f.tie", "f.start").alias("first"))
    whole = again.join(more, ["a", "h"]).where(place > F.col("first")).select("doc", "tie", "start", (F.col("start") + F.col("n") + LENGTH - 1).alias("end"))
    hot = ((F.count("*") > HOT) | (F.sum(F.col("f.n") + LENGTH - 1) > HEAVY)).alias("hot")
    several = firsts.groupBy("a").agg(F.count("*").alias("k"), F.max("own").alias("self"), hot).where("k > 1 or self")
    left = firsts.join(several, "a").select("f.doc", "f.tie", F.struct("a", "f.start", "f.n", "hot").alias("r"))
    lists_ = written(left.groupBy("doc", "tie").agg(F.collect_list("r").alias("own")), "suffix-left")
    # These lists grow with the input, so texts are shuffled to them at every size.
    bits = written(docs.join(lists_.hint("merge"), ["doc", "tie"]).mapInArrow(_sliced, "a long, hot boolean, doc long, tie long, start int, s binary"), "suffix-bits")
    discard(lists_)
    cold = bits.where("not hot").repartition("a").sortWithinPartitions("a")
    found = whole.unionAll(cold.mapInArrow(_merge, "doc long, tie long, start int, end int"))
    used = [again, firsts, bits]
    if not bits.where("hot").isEmpty():
        dealt = written(bits.where("hot").mapInArrow(_recut, "a long, doc long, tie long, start int, s binary"), "suffix-recut")
        sizes = dealt.groupBy("a").agg(F.count("*").alias("k"), F.sum(F.length("s")).alias("b")).where((F.col("k") > HOT) | (F.col("b") > HEAVY)).select("a")
        sizes = written(sizes, "suffix-crowded")
        # A crowded part has HOT rows or HEAVY bytes at least, so these are few; still a shuffled join, which splits them.
        cool = dealt.join(sizes.hint("merge"), "a", "left_anti").repartition("a").sortWithinPartitions("a")
        found = found.unionAll(cool.mapInArrow(_merge, "doc long, tie long, start int, end int"))
        windows = written(dealt.join(sizes.hint("merge"), "a", "left_semi").mapInArrow(_windows, "w binary, doc long, tie long, start int"), "suffix-windows")
        used += [dealt, sizes, windows]
        least = windows.groupBy("w").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
        found = found.unionAll(windows.join(least, "w").where(place > F.col("first")).select("doc", "tie", "start", (F.col("start") + LENGTH).alias("end")))
    own = found.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("own"))
    gone = written(own.mapInArrow(_united, "doc long, tie long, gone binary"), "suffix-gone")
    discard(*used)
    return gone


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept
    (the remaining bytes; removal may cut a character).

    Order is by doc_id; a null doc_id comes last. Rows that repeat both doc_id
    and text are one document and get the same result; of rows that repeat a
    doc_id with other texts the order is by the text's hash. Null and empty
    texts, and those below LENGTH bytes, stay as they are; texts may be of any
    length. An empty table has no rows; extra columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keyed = rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("tie"), "text")
    gone = ranges(keyed.drop("doc_id"))
    out = keyed.join(gone.hint("merge"), ["doc", "tie"], "left").select("doc_id", "text", "gone")
    return out.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
