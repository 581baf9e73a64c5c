"""Fingerprints and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import components, simhash


def brute_print(text):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, ids):
    root = {i: i for i in range(len(ids))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_documents(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in rows]
    want = {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(rows, prints, brute_components(prints, [r.doc_id for r in rows]), strict=True)}
    got = simhash.near_duplicates(spark.read.parquet(f"{data}/documents.parquet")).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want and len(got) == len(rows)


def test_odd_rows(docs_of, odd):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(odd).withColumnRenamed("lang", "fp")).collect()}
    assert len(got) == len(odd) and {got[k].component_id for k in (0, 1, 2)} == {0} and got[0].fingerprint == "0" * 16
    assert got[5].component_id == 4 and got[3].fingerprint == f"{xxhash.xxh64_intdigest(b'one', 42):016x}"
    assert simhash.near_duplicates(docs_of([])).collect() == []
    kept = simhash.keep_representatives(docs_of(odd))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in got.values()}) and kept.columns == docs_of([]).columns


@pytest.mark.parametrize("seed", [1, 2])
def test_full_keys_lose_no_link(spark, seed):
    """Thousands of fingerprints around few centres: keys overflow and are cut again."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(3)]
    prints = {c ^ (1 << rng.randrange(24)) ^ (1 << rng.randrange(24)) ^ (1 << rng.randrange(12)) for c in centres for _ in range(700)} | {rng.getrandbits(64) for _ in range(200)}
    a = np.array(sorted(prints), np.uint64)
    fps = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")
    got = {(r.u, r.v) for r in simhash.links(fps).collect()}
    root = {int(x): int(x) for x in a.view(np.int64)}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in got:
        assert ((u ^ v) % (1 << 64)).bit_count() <= 2
        root[find(u)] = find(v)
    s = a.view(np.int64)
    for i in range(len(a)):
        for j in np.nonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 2)[0].tolist():
            assert find(int(s[i])) == find(int(s[i + 1 + j]))


def test_other_radius(spark):
    """Three bits by six blocks, keys that are too full included."""
    rng = random.Random(3)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    far = [flip(c, k) for c in [rng.getrandbits(64) for _ in range(60)] for k in (0, 3, 4)]
    c = rng.getrandbits(64)
    a = np.array(sorted({*far, *(flip(c, k) for k in (0, 1, 2, 3) for _ in range(150))}), np.uint64)
    fps = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(fps, 3, 6)).collect()}
    s = a.view(np.int64).tolist()
    pairs = [(s[i], s[j]) for i in range(len(s)) for j in range(i) if (int(a[i]) ^ int(a[j])).bit_count() <= 3]
    assert all(u in roots and v in roots and roots[u] == roots[v] for u, v in pairs) and {x for p in pairs for x in p} == set(roots)
    assert len(simhash.first_masks(3, 6)) == 20 and simhash.first_masks() == simhash.first_masks(2, 4)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(400)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({got[i] for i in range(401)}) == 1 and len({got[1000 + i] for i in range(300)}) == 1 and len(set(got.values())) == 2
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
