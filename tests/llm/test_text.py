"""Chat formatting, quality rules and license scans against brute force."""

import collections
import functools
import math
import re
import sys

from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/llm/", 1)[0])
from oracle import compare, database

from tidemark.llm import chat, licenses, quality, queries

PARTS = "array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"


def test_op2_equals_sql(spark, data):
    assert compare(queries.op2_chat(spark, data), queries.oracle_sql()["op2_chat"], database(data)) == ""


def test_escapes_are_reversible(spark, odd):
    texts = [t or "" for t in odd] + ["\\", "\\\\<|", "<\\|", "<</SYS>> <SYS>>", "[INST][/INST]", "<s></s>", "<|\\", "[\\INST]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t
        assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", r.e)


def test_parts_in_order(spark):
    content = [("text", "see <|end|>\n", None, None, None, None, None), ("image", None, "a.png", 280, 57, None, None), ("audio", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 3), ("video", None, "d", None, None, None, None), None]
    rows = [(1, 1, "assistant", None), (1, 0, "user", content), (2, None, None, []), (None, 0, "assistant", [("text", "x", None, None, None, None, None)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content {PARTS}").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert [(a.kind, a.uri, a.tokens) for a in got[1].attachments] == [("image", "a.png", 30), ("audio", "b.wav", 38), ("document", "c.pdf", 768), ("other", "d", 1)]
    assert got[1].placeholder_tokens == 837 and got[1].formatted.startswith("<|turn|>user<|says|>see <\\|end|>\n<|image|><|audio|><|document|><|other|><|end|>\n<|turn|>assistant")
    assert got[2].formatted == "<|turn|><|says|><|end|>\n" and got[2].loss_spans == []
    s = got[None].loss_spans[0]
    assert got[None].formatted[s["from"] : s.before] == "x"
    assert chat.format_chats(df.where("false")).count() == 0


def brute_quality(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen = collections.defaultdict(list)
    for i in range(len(words) - 4):
        seen[tuple(words[i : i + 5])].append(i)
    covered = {j for places in seen.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    bad = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), bad


def test_op4_counts(spark, data, docs_of, odd):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = odd + ["a b c d e a b c d e a b c d e f", "x y\nx y\n\nx y\n z", "!!! $$$ ### <<< |||"]
    for df in (docs, docs_of(rows)):
        texts = {r.doc_id: r.text for r in df.collect()}
        got = quality.judge(df.withColumn("n_words", F.lit("clash")), labels).collect()
        assert len(got) == len(texts)
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(texts[r.doc_id])
            assert not (r.base_failed and r.kept)
    assert quality.judge(docs_of([]), labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == quality.judge(docs, labels).where("kept").count()


def test_binomial_bound():
    for n, k, p in ((10, 0, 0.1), (50, 3, 0.02), (200, 1, 0.05), (1000, 30, 0.02), (7, 7, 0.5)):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(quality.binomial_tail(k, n, p) - exact) < 1e-10


def test_cutoffs_control_the_risk(spark, docs_of):
    """Good documents have few marks, bad ones many; the cutoff rejects the bad and hardly a good one."""
    good = [" ".join(f"w{n}x{k}" for k in range(20)) + "!" * (n % 3) for n in range(3000)]
    bad = [" ".join(f"b{n}x{k}!!" for k in range(20)) for n in range(300)]
    docs = docs_of(good + bad)
    labels = docs.select("doc_id", (F.col("doc_id") < len(good)).cast("int").alias("quality"))
    out = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    assert sum(not out[i] for i in range(len(good))) <= quality.RISK * len(good)
    assert not any(out[len(good) + i] for i in range(len(bad)))
    none = quality.judge(docs, labels.where("false"))
    assert none.where("kept <> (NOT base_failed)").count() == 0


def test_some_hundred_labels_suffice(spark, docs_of):
    """Six hundred labels certify a cutoff; copies of a few texts don't, however many rows they have."""
    good = [" ".join(f"w{n}x{k}" for k in range(20)) for n in range(600)]
    bad = [" ".join(f"b{n}x{k}!!" for k in range(20)) for n in range(60)]
    docs = docs_of(good + bad)
    labels = docs.select("doc_id", (F.col("doc_id") < len(good)).cast("int").alias("quality"))
    kept = {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}
    assert kept == set(range(len(good)))
    few = docs_of([good[n % 50] for n in range(len(good))] + bad)
    assert quality.judge(few, labels).where("not kept").count() == 0
    mixed = docs.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, "rare").otherwise("en"))
    assert {r.lang for r in mixed.join(quality.judge(mixed, labels).where("not kept").select("doc_id"), "doc_id").select("lang").distinct().collect()} == {"en"}


def brute_license(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    found = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_op5(spark, data, docs_of, odd):
    rows = odd + ["Under-the MIT  LICENSE under the mit license", "cc-by_nc CC BY NC", "Apache License, Version 2.0 and KK under THE mit licenSe"]
    for df in (spark.read.parquet(f"{data}/documents.parquet"), docs_of(rows)):
        texts = {r.doc_id: r.text for r in df.collect()}
        got = licenses.summary(licenses.scan(df.withColumn("norm", F.lit("clash")))).collect()
        assert len(got) == len(texts)
        for r in got:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(texts[r.doc_id])
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan(docs_of([])).count() == 0


def test_signature_rules(docs_of):
    texts = ["SPDX-License-Identifier: GPL-3.0-or-later", "licensed under the GNU Lesser General Public License version 2.1; see the BSD 3-Clause License", "released under the Apache License, Version 2.0", "in the mit der license", "This work is licensed under a Creative Commons Attribution-ShareAlike license", "license plates and driving licenses"]
    got = licenses.summary(licenses.scan(docs_of(texts))).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["gpl-3", "bsd-3,lgpl-2.1", "apache-2", "", "cc-by-sa", ""]
    assert len(licenses.signature_rules()) > 200
    inside = licenses.scan(docs_of(texts[:1])).first().detections
    assert len(inside) == 1  # shorter detections inside it are suppressed


def test_bodies_and_notices(docs_of):
    texts = [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")",
        "This text is dedicated to the public domain.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "you can redistribute it and/or modify it", "All rights reserved.",
    ]
    got = licenses.summary(licenses.scan(docs_of(texts))).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["bsd", "mit", "public-domain", "mpl-2", "", "proprietary"]


def test_no_gate_loses_a_rule(docs_of, monkeypatch):
    """A text of every phrase around a name of every family has the same detections with and without gate and keywords."""
    names = {}
    for label, pattern in licenses.lines(licenses.FAMILIES):
        options = [pattern] if not pattern.startswith("(?:") else pattern[3:].split(")")[0].split("|")
        for o in options:
            plain = re.sub(r"\(\?:[^()]*\)\??|\[.*?\]|\\w\*|\?", "", o)
            names.setdefault(label, []).append(" ".join(plain.replace(")", "").split()))
    ways = [f"{verb} {to} the {{}} here" for verb in ("released", "Distributed", "available", "provided", "published") for to in ("in", "under", "into")]
    ways += ["SPDX-License-Identifier: {} x", "licensed under {} x", "subject to {} licence x", "the {} license x", "license is {} x"]
    texts = [w.format(n) for own in names.values() for n in own for w in ways]
    texts += ["Released under GPL v3", "distributed under CC BY-SA 4.0", "available under the Apache 2.0", "released into the public domain", "published under CC0", "released under expat"]
    steps = [(r"\.\{\d+,\d+\}", "some words "), (r"\(\?:[^()]*\)\?", ""), (r"\(\?:([^()|]*)[^()]*\)", r"\1"), (r"\?", ""), (r"\[(.)[^]]*\]", r"\1")]
    texts = [functools.reduce(lambda t, step: re.sub(*step, t), steps, p) for _, p, _ in licenses.lines(licenses.SIGNATURES)] + texts
    rows = lambda: [tuple(r) for r in licenses.summary(licenses.scan(docs_of(texts))).orderBy("doc_id").collect()]
    got = rows()
    assert [r[6] for r in got[-6:]] == ["gpl-3", "cc-by-sa", "apache-2", "public-domain", "cc0", "mit"] and all(r[7] > 0 for r in got[-6:])
    signatures = licenses.lines(licenses.SIGNATURES)
    assert [(label, r[6], t) for (label, _, _), r, t in zip(signatures, got, texts, strict=False) if label not in r[6].split(",")] == []
    ungated = [r | {"keywords": [""]} for r in licenses.signature_rules()]
    monkeypatch.setattr(licenses, "TRIGGERS", ("",))
    monkeypatch.setattr(licenses, "signature_rules", lambda: ungated)
    assert rows() == got
