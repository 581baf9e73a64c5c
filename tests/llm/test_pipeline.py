"""Each stage against its operator's own results, and the whole."""

import corpus_pipeline
from test_minhash import brute_kept
from tidemark.llm import decontaminate, quality, queries, secrets


def test_stages_keep_what_their_operators_keep(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    want = {
        "quality rules": lambda d: ids(quality.judge(d, labels).where("kept")),
        "near-duplicates": lambda d: sorted(rows[i][0] for rows in [[(r.doc_id, r.text) for r in d.collect()]] for i in brute_kept(rows)),
        "decontamination": lambda d: sorted(set(ids(d)) - {r.doc_id for r in decontaminate.leaks(d, bench).collect()}),
        "secrets": ids,
        "token ids": ids,
    }
    assert [n for n, _ in corpus_pipeline.STAGES] == list(want)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data).cache()
        assert ids(out) == want[name](docs)
        if name != "token ids":
            assert out.columns == docs.columns and out.schema == docs.schema
        if name == "secrets":
            assert secrets.scan(out).where("secret").count() == 0
        docs = out
    assert ids(corpus_pipeline.run(spark, data)) == ids(docs)


def test_every_query_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names) and set(queries.oracle_sql()) == {"op2_chat"}
