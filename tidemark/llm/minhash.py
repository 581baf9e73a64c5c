"""Near copies by the Jaccard similarity of word shingles: SimHash and then MinHash bands propose pairs, the whole sets decide.

Texts with equal sets of shingles are one node. Nodes whose SimHash fingerprints differ in at most `CLOSE` bits are linked first,
by the blocks of op1's operator. Sets of similarity 0.8 differ in some 10 of 64 bits, too many for blocks, so bands
complete these links. A band is a hash of `ROWS` minima; two sets of similarity s share one
of `BANDS` bands with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9999 at 0.8, more above. In each band value, nodes that
aren't linked yet are first held against their neighbour in a random order, so a large group of near copies comes together
in pairs that grow with its size, not its square, and against the node with the smallest share of hashes of its own.
Then whoever isn't in a value's largest component is held against all nodes of other components with which it has one of its
rarest hashes in common, as any two similar sets have. Nothing is cut: each two nodes that share a band are in one component, or compared,
or too different. Every link, by fingerprint or band, has its exact similarity checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, simhash
from .components import components
from .simhash import shingle_hashes

SHINGLE, BANDS, ROWS, SEED = 5, 24, 5, 42
#: Bits in which fingerprints that are linked may differ, and the blocks for it: keys have 32 bits, as op1's.
CLOSE, BLOCKS = 3, 6
#: Similarity from which texts are near copies, as a fraction so that the test is exact.
SIMILAR = (4, 5)
#: Shingles that are hashed at once.
AT_ONCE = 4096


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


_rng = np.random.default_rng(SEED)
FLIPS, FACTORS = (_rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed long for each band of a set that isn't empty; none for an empty one."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), AT_ONCE):
        least = np.minimum(least, ((hashes[at : at + AT_ONCE] ^ FLIPS) * FACTORS).min(axis=1))
    raw, width = least.tobytes(), 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(raw[k * width : (k + 1) * width], k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def signatures(rows: DataFrame) -> DataFrame:
    """(row, doc_id, same, size, fp, bands) of rows(row, doc_id, text): a digest of the set, its size, fingerprint and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(2).to_pylist()]
            prints = np.array([simhash.fingerprint(s) for s in sets], np.uint64).view(np.int64)
            made = [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["row", "doc_id", "same", "size", "fp", "bands"])

    return rows.mapInArrow(run, "row long, doc_id long, same binary, size long, fp long, bands array<long>")


def sets_of(rows: DataFrame) -> DataFrame:
    """(node, hashes) of rows(row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = pa.array([shingle_set(t).view(np.int64) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), sets], names=["node", "hashes"])

    return rows.select("row", "text").mapInArrow(run, "node long, hashes array<long>")


def enough(common: Column, both: Column) -> Column:
    """Are sets with so many common hashes, and so many in all, as similar as SIMILAR?"""
    top, bottom = SIMILAR  # common / (both - common) >= top / bottom
    return common * (top + bottom) >= both * top


def could_match(size: Column, lone: Column, other_size: Column, other_lone: Column) -> Column:
    """Can sets of these sizes, with so many hashes that no other set has, be similar? They share no more than what's left."""
    return enough(F.least(size - lone, other_size - other_lone), size + other_size)


def lone_hashes(sets: DataFrame) -> DataFrame:
    """(node, size, lone) of sets(node, hashes): hashes that no other of the sets has. Counts are combined before the shuffle,
    so a passage that all texts share is a row for each task."""
    alone = sets.select("node", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    found = alone.groupBy("node").agg(F.count("*").alias("lone"))
    return sets.select("node", F.size("hashes").alias("size")).join(found, "node", "left").select("node", "size", F.coalesce("lone", F.lit(0)).alias("lone"))


def rarest(sets: DataFrame) -> DataFrame:
    """(node, hash, short) of sets(node, hashes): the rarest hashes of each, one of which is in common with any similar set.

    Of two similar sets the smaller has a common one among its `short` rows, the larger among all its rows: all hashes but so
    many less one as it must share with a set that is at least as large, or at most as large.
    """
    top, bottom = SIMILAR
    each = sets.select("node", F.size("hashes").alias("size"), F.explode("hashes").alias("hash"))
    counts = each.groupBy("hash").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("n", "hash"))
    spare = lambda of: F.floor(F.col("size") * (bottom - top) / of) + 1
    found = each.join(counts, "hash").withColumn("place", place).where((F.col("place") <= spare(bottom)) & (F.col("n") > 1))
    return scratch.keep(found.select("node", "hash", (F.col("place") <= spare(top + bottom)).alias("short")), "rarest")


def proposed(members: DataFrame, rare: DataFrame) -> DataFrame:
    """Pairs (u, v) of members(node, root, size, lone, out) that could be similar, have different roots, and have one that is out."""
    own = rare.join(members, "node")
    named = lambda df, c: df.select("hash", *(F.col(x).alias(f"{c}_{x}") for x in ("node", "root", "size", "lone", "out")))
    smaller, larger = named(own.where("short"), "a"), named(own, "b")
    first = F.when(F.col("a_out") & F.col("b_out"), F.col("a_node") < F.col("b_node")).otherwise(F.col("a_out"))  # of two as large
    can = could_match(*map(F.col, ("a_size", "a_lone", "b_size", "b_lone"))) & (F.col("a_root") != F.col("b_root")) & (F.col("a_out") | F.col("b_out"))
    pairs = smaller.join(larger, "hash").where(can & ((F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & first)))
    return pairs.select(*ordered(F.col("a_node"), F.col("b_node"))).distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs(u, v) whose sets are similar."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}_hashes"))
    common, both = F.size(F.array_intersect("u_hashes", "v_hashes")), F.size("u_hashes") + F.size("v_hashes")
    return pairs.join(side("u"), "u").join(side("v"), "v").where(enough(common, both)).select("u", "v")


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def close(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes(node, size, fp) with linked fingerprints: the first node of one and that of the other, or of equal ones each with the first."""
    own = nodes.where("size > 0").select("node", "fp")
    prints = scratch.keep(own.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "prints")
    equal = own.join(prints.where("n > 1"), "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    side = lambda c: prints.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
    near = simhash.links(prints.select("fp"), CLOSE, BLOCKS).join(side("u"), "u").join(side("v"), "v").select(*ordered(F.col("u_first"), F.col("v_first")))
    return scratch.keep(equal.unionByName(near), "close")


def links(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (u, v) of similar nodes(node, size, fp, bands), enough to connect whatever similar pairs that share a band connect,
    and all of similar sets that close() gives.

    A set that shares a band with none and is close to none, or has more hashes of its own than a similar one could lack, is in no pair, so a group
    of copies with many edits each costs its size. What is left of a value is held against its neighbours first, and against the
    set with the least of its own, to which all copies of one text are close that can be close to each other.
    """
    turn = Window.partitionBy("val").orderBy(F.xxhash64("node", "val"), "node")
    each = nodes.select("node", F.explode("bands").alias("val"))
    others = each.select("node", "val", F.lag("node").over(turn).alias("before"), F.lead("node").over(turn).alias("after"))
    shared = scratch.keep(others.where("before is not null or after is not null").select("node", "val"), "shared")
    pairs = close(nodes)
    wanted = shared.select(F.col("node").alias("row")).unionByName(pairs.select(F.explode(F.array("u", "v")).alias("row"))).distinct()
    sets = scratch.keep(sets_of(rows.join(wanted, "row", "left_semi")), "sets")
    able = scratch.keep(lone_hashes(sets).where((F.col("size") - F.col("lone")) * SIMILAR[1] >= F.col("size") * SIMILAR[0]), "able")
    side = lambda c: able.select(F.col("node").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("size", "lone")))
    near = pairs.join(side("u"), "u").join(side("v"), "v").where(could_match(*map(F.col, ("u_size", "u_lone", "v_size", "v_lone"))))
    linked = scratch.keep(verified(near.select("u", "v"), sets), "linked")
    placed = able.join(components(linked), "node", "left").withColumn("root", F.coalesce("root", "node"))
    beside = shared.join(placed, "node").select("*", *(F.lag(c).over(turn).alias(f"before_{c}") for c in ("node", "size", "lone", "root")))
    beside = scratch.keep(beside, "beside")
    first = beside.where((F.col("before_root") != F.col("root")) & could_match(*map(F.col, ("size", "lone", "before_size", "before_lone"))))
    core = F.min(F.struct((F.col("lone") / F.col("size")).alias("share"), "node", "size", "lone", "root")).alias("core")
    inner = beside.join(beside.groupBy("val").agg(core), "val").where(F.col("root") != F.col("core.root"))
    inner = inner.where(could_match(*map(F.col, ("size", "lone", "core.size", "core.lone"))))
    first = first.select(*ordered(F.col("node"), F.col("before_node"))).unionByName(inner.select(*ordered(F.col("node"), F.col("core.node"))))
    first = scratch.keep(first.distinct(), "neighbours")
    found = scratch.keep(linked.unionByName(verified(first, sets)), "links")
    rooted = beside.select("node", "size", "lone", "val").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = scratch.keep(rooted, "rooted")
    tops = rooted.groupBy("val", "root").agg(F.count("*").alias("n")).groupBy("val").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root"))["root"].alias("top"))
    mixed = scratch.keep(rooted.join(tops.where("roots > 1").select("val", "top"), "val"), "mixed")
    members = mixed.groupBy("node", "root", "size", "lone").agg(F.bool_or(F.col("root") != F.col("top")).alias("out"))
    members = scratch.keep(members, "members")
    rest = proposed(members, rarest(sets.join(members.select("node"), "node", "left_semi")))
    rest = scratch.keep(rest.join(first, ["u", "v"], "left_anti"), "rest")
    scratch.drop(shared, pairs, able, linked, beside, rooted, mixed, members, first)
    if rest.isEmpty():
        return found
    return scratch.keep(found.unionByName(verified(rest, sets)), "all-links")


def keep_representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' rows, exactly one of each group of near copies: that of the smallest doc_id, null ones last.

    Rows are told apart by a key of their own, so repeated and null doc_ids lose nothing else. Texts without words are
    one group; a text of up to SHINGLE words is one shingle. Other columns are kept as they are.
    """
    scratch.long_rows(docs.sparkSession)
    name = "row"
    while name in docs.columns:
        name += "_"
    kept = scratch.keep(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    rows = kept.select(F.col(name).alias("row"), F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    own = scratch.keep(signatures(rows), "signatures")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    least = own.groupBy("same").agg(F.min(place).alias("place"))
    nodes = scratch.keep(least.select("place").join(own.select("row", "size", "fp", "bands"), F.col("place.row") == F.col("row")).select(F.col("row").alias("node"), "place", "size", "fp", "bands"), "nodes")
    roots = components(links(nodes, rows))
    firsts = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("place")["row"].alias(name))
    return kept.join(firsts.select(name), name, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
