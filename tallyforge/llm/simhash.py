"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two 32-bit segments. Of two fingerprints
that differ in at most 3 bits, one segment differs in at most one bit. Each
segment is indexed under 32 variants with one bit struck out, so such a pair
has an equal key in at least one of 64. Fingerprints are grouped by equal key
and verified there. Copies of one fingerprint are one entry.

Groups too large for one task (HOT) are cut again by the same rule: the
other half into two 16-bit pieces, the rest of that into two 8-bit pieces.
Then 53 bits are common and at most 2048 fingerprints are left, so every group
is bounded and no candidate is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, sized, written
from .graph import components

MAX_BITS = 3
#: Fingerprints of one key that one task compares; 128 kB of them.
HOT = 16_384
LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str, words_in_shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text (contract of op7)."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    k = words_in_shingle
    shingles = [b" ".join(w)] if len(w) < k else map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 255):  # a byte lane holds at most 255 ones
        part = h[at : at + 255]
        for k in range(8):
            lanes = np.add.reduce((part >> np.uint64(k)) & LANES, dtype=np.uint64)
            ones[k::8] += np.frombuffer(np.uint64(lanes).tobytes(), np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the unsigned fingerprint's bits as a long)."""
    return documents(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


def _variants(seg: str, width: int, tag: int) -> str:
    """SQL: an array of width keys of the segment, each without one bit;
    the key holds which bit and which segment."""
    return (
        f"transform(sequence(0, {width - 1}), j -> ({seg} & ~shiftleft(1L, j))"
        f" | shiftleft(cast(j as bigint), {width}) | shiftleft({tag}L, {width + 6}))"
    )


def _level(rows: DataFrame, level: int) -> DataFrame:
    """rows (k0.., fp) with one more key column: the variants of this level."""
    if level == 0:
        parts, width = ["(fp & 4294967295L)", "shiftrightunsigned(fp, 32)"], 32
    elif level == 1:  # the half that k0's segment isn't
        rows = rows.withColumn("rest", F.expr("if(shiftrightunsigned(k0, 38) = 0, shiftrightunsigned(fp, 32), fp & 4294967295L)"))
        parts, width = ["(rest & 65535L)", "shiftrightunsigned(rest, 16)"], 16
    else:
        rows = rows.withColumn("rest", F.expr("if(shiftrightunsigned(k1, 22) = 0, shiftrightunsigned(rest, 16), rest & 65535L)"))
        parts, width = ["(rest & 255L)", "shiftrightunsigned(rest, 8)"], 8
    keys = f"concat({_variants(parts[0], width, 0)}, {_variants(parts[1], width, 1)})"
    return rows.withColumn(f"k{level}", F.explode(F.expr(keys)))


def _linked(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected at MAX_BITS among distinct
    fingerprints: a breadth-first tree, so one link per reached entry."""
    left, out = fps, []
    while len(left):
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            near = np.bitwise_count(left ^ todo.pop()) <= MAX_BITS
            if near.any():
                todo.extend(found := left[near])
                out.extend((int(x), int(root)) for x in found)
                left = left[~near]
    return out


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by key; a group may span batches."""
    rest = None
    seen: set[tuple[int, int]] = set()

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["key"].to_numpy()
        fps = pdf["fp"].to_numpy().view(np.uint64)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        out = []
        for part in np.split(fps, cuts):
            out.extend(_linked(part))
        new = set(out) - seen
        if len(seen) > 1_000_000:
            seen.clear()
        seen.update(new)
        pairs = np.array(sorted(new), np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"src": pairs[:, 0], "dst": pairs[:, 1]})

    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        last = int(np.searchsorted((pdf["key"] != pdf["key"].iloc[-1]).to_numpy()[::-1], True)) if len(pdf) else 0
        rest, done = pdf.iloc[len(pdf) - last :], pdf.iloc[: len(pdf) - last]
        if len(done):
            yield links(done)
    if rest is not None and len(rest):
        yield links(rest)


def links(distinct: DataFrame) -> DataFrame:
    """Links (src, dst) among distinct fingerprints (column fp) whose
    components are those of all pairs within MAX_BITS."""
    rows, found = distinct.select("fp"), []
    for level in range(3):
        keys = [f"k{i}" for i in range(level + 1)]
        rows = _level(rows, level)
        groups = written(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), f"simhash-keys{level}")
        found.append(groups.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select(F.col("b").alias("src"), F.col("a").alias("dst")))
        counts = groups.agg(F.count_if(F.col("n") > 2).alias("many"), F.count_if(F.col("n") > HOT).alias("hot")).first()
        if not counts["many"]:
            break
        # Keys of few fingerprints are most; those of several fit a broadcast up to its checked size.
        many = sized(groups.where("n > 2").select(*keys, "n"), counts["many"], 96)
        members = rows.join(many, keys)
        cold = members if level == 2 else members.where(F.col("n") <= HOT)
        # Always a hash: were the key the join's own, Spark would drop the exchange as
        # redundant, and reading the join's shuffle by mapper would part a key's rows. Keys
        # with equal hashes are compared together, which adds no link.
        key = F.xxhash64(F.lit("group"), *keys)
        cold = cold.select(key.alias("key"), "fp").repartition("key").sortWithinPartitions("key")
        found.append(cold.mapInPandas(_verify, "src long, dst long"))
        if level == 2 or not counts["hot"]:
            break
        rows = members.where(F.col("n") > HOT).drop("n")
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out.distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id per row of docs.

    Fingerprints within MAX_BITS are linked; component_id is the smallest
    doc_id of the connected component. Texts without words have fingerprint
    zero and are linked like any other. Repeated rows keep one result row each.
    A component of rows without any doc_id has a null component_id.
    """
    fps = written(fingerprints(docs), "simhash-fp")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    member = components(written(links(distinct), "simhash-links"))
    roots = distinct.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    moved = roots.where("root <> fp").groupBy("root").agg(F.min("first").alias("least"))
    ids = (
        roots.join(moved, "root", "left")
        .join(distinct.select(F.col("fp").alias("root"), F.col("first").alias("own")), "root", "left")
        .select("fp", F.least("least", "own").alias("component_id"))
    )
    return fps.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
