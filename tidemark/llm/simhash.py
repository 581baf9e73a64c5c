"""SimHash near-duplicate detection by pigeonhole blocks.

A 64-bit fingerprint is cut into four blocks. Two fingerprints that differ in at most two bits agree on
at least two blocks, so each of the six pairs of blocks is a key to join on; pairs that share a key are
then verified by their Hamming distance. Equal fingerprints are one row before any of this. Keys that
more than `FULL` fingerprints share are not joined but cut again: their other bits fall into three parts,
of which such a pair shares one. This ends when so few bits are left that a key can't hold many, so every
link is found without a pair for all members of a group. Other radii take as many more blocks and parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import components

BITS, BLOCKS, NEAR, SEED, SHINGLE = 64, 4, 2, 42, 3
#: Fingerprints that may share a key and still be joined in pairs.
FULL = 64
#: With so few bits left, a key can't have more than 2 ** FEW fingerprints.
FEW = 7


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle, repeats included. bytes.lower() and bytes.split() know A-Z and \\x20\\x09-\\x0D alone."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([of(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-size].tolist()]
    return np.fromiter((of(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes; none: zero."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 50_000):
        part = hashes[at : at + 50_000].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp as a signed long) for each row. Null or empty texts, and such without words, have zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(shingle_hashes(t)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")).mapInArrow(run, "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def first_masks(near: int = NEAR, blocks: int = BLOCKS) -> list[int]:
    ends = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in pairwise(ends)]
    return [signed(sum(some)) for some in combinations(parts, blocks - near)]


def next_masks(mask: int, near: int = NEAR) -> list[int]:
    """mask with each part (a third, where near is two) of the bits that it lacks."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [signed((mask % (1 << BITS)) | sum(1 << b for b in free[k :: near + 1])) for k in range(near + 1)]


def links(fps: DataFrame, near: int = NEAR, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (u, v), u < v, of distinct fingerprints (column fp) with at most `near` differing bits: enough of
    them, and each one verified, that they connect whatever such pairs connect; in keys that aren't too full, all."""
    masks = first_masks(near, blocks)
    rows = fps.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    out = None
    while True:
        keyed = rows.select("fp", "mask", F.expr("fp & mask").alias("val"))
        sizes = keyed.groupBy("mask", "val").agg(F.count("*").alias("n")).where("n > 1")
        last = [m for m in masks if BITS - (m % (1 << BITS)).bit_count() <= FEW]
        full = (F.col("n") > FULL) & ~F.col("mask").isin(last) if last else F.col("n") > FULL
        shared = scratch.keep(keyed.join(sizes, ["mask", "val"]).select("fp", "mask", "val", full.alias("full")), "shared")
        few = shared.where("not full").select("mask", "val", F.col("fp").alias("u"))
        found = few.join(few.withColumnRenamed("u", "v"), ["mask", "val"]).where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= near)).select("u", "v").distinct()
        out = found if out is None else out.unionByName(found)
        if shared.where("full").isEmpty():
            return out.distinct()
        children = {m: next_masks(m, near) for m in masks}
        masks = sorted({c for some in children.values() for c in some})
        table = F.create_map(*(x for m, some in children.items() for x in (F.lit(m), F.array(*map(F.lit, some)))))
        rows = shared.where("full").select("fp", F.explode(F.element_at(table, F.col("mask"))).alias("mask")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id: the smallest doc_id reachable by links) for each row.

    Null and empty texts share fingerprint zero and so a component. Rows that repeat a doc_id are each given,
    with their own fingerprints. A null doc_id is in no component's minimum unless it has no other member (then null).
    Other columns are not read. An empty table gives no rows.
    """
    own = scratch.keep(fingerprints(docs, key, text), "fingerprints")
    fps = scratch.keep(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(fps))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = scratch.keep(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "classes")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(classes, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' rows, one document of each group of near copies: the one with the smallest doc_id. Rows that
    repeat that doc_id are the same document and all stay, and so do rows without a doc_id."""
    gone = near_duplicates(docs, key, text).where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
