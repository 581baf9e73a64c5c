"""The pipeline's near-duplicates stage against brute force."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import minhash


def brute_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(rows):
    """Row numbers that stay of rows (doc_id, text): one of each component of pairs with similarity 0.8."""
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return [min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)) for g in groups.values()]


def test_documents(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    out = corpus_pipeline.keep_distinct(spark, df, data)
    assert sorted(r.doc_id for r in out.collect()) == sorted(rows[i][0] for i in brute_kept(rows)) and out.schema == df.schema


def test_edited_copies(spark, docs_of, odd):
    """Copies with scattered edits, chains of them, one large group, and texts that are just not similar enough."""
    rng = random.Random(4)
    texts = list(odd)
    for size in (12, 40, 100, 300):
        w = [f"w{rng.randrange(900)}" for _ in range(size)]
        for edits in (0, 1, 2, size // 45, size // 40, size // 10):
            c = list(w)
            for _ in range(edits):
                c[rng.randrange(size)] = "zz"
            texts.append(" ".join(c))
    w = [f"v{k}" for k in range(200)]
    texts += [" ".join([*w[:k], f"n{n}", *w[k + 1 :]]) for n in range(150) for k in [rng.randrange(200)]]
    chain = [f"c{k}" for k in range(90)]
    texts += [" ".join(chain[k : k + 60]) for k in range(0, 30, 3)]
    ids = [i // 2 if i % 9 else None for i in range(len(texts))]
    got = minhash.keep_representatives(docs_of(texts, ids).coalesce(1))
    rows = list(zip(ids, texts, strict=True))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted((rows[i] for i in brute_kept(rows)), key=key)
    assert minhash.keep_representatives(docs_of([])).collect() == []


def nodes_and_rows(texts, docs_of):
    """What minhash.links takes, with texts as nodes 0, 1, ... that share no band."""
    rows = docs_of(texts).select(F.col("doc_id").alias("row"), "doc_id", "text")
    return minhash.signatures(rows).select(F.col("row").alias("node"), "size", "fp", F.array("row").alias("bands")), rows


def test_fingerprints_link_without_bands(docs_of):
    """Pairs with few edits, and equal fingerprints of sets that differ, are found by SimHash alone; each is checked on whole sets."""
    rng = random.Random(8)
    texts = []
    for k in range(40):
        w = [f"a{rng.randrange(10**6)}" for _ in range(400)]
        texts += [" ".join(w), " ".join([*w[:-1], f"e{k}"])]
    nodes, rows = nodes_and_rows(texts, docs_of)
    prints = {r.node: r.fp for r in nodes.collect()}
    want = {(i, i + 1) for i in range(0, 80, 2) if ((prints[i] ^ prints[i + 1]) % (1 << 64)).bit_count() <= minhash.CLOSE}
    assert len(want) >= 20 and {(r.u, r.v) for r in minhash.links(nodes, rows).collect()} == want
    same = nodes.withColumn("fp", F.lit(7).cast("long")).where("node in (0, 1, 2)")
    assert {(r.u, r.v) for r in minhash.close(same).collect()} == {(0, 1), (0, 2)}
    assert {(r.u, r.v) for r in minhash.links(same, rows).collect()} == {(0, 1)}


def test_stage_takes_fingerprints(docs_of, monkeypatch):
    """The stage asks op1's operator for its links."""
    asked, links = [], minhash.simhash.links
    monkeypatch.setattr(minhash.simhash, "links", lambda fps, *radius: asked.append(radius) or links(fps, *radius))
    kept = corpus_pipeline.keep_distinct(None, docs_of(["a b c", "a b c", "d"]), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2] and asked == [(minhash.CLOSE, minhash.BLOCKS)]
