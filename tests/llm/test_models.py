"""Embedding links, quality classifier, licence scan and pipeline."""

import random
import zlib

import numpy as np

import corpus_pipeline
from outagelab.llm import embeddings, licenses, quality

from .corpus import documents, empty, rows, sentence


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 16))
    out = [b.tolist() for b in base]
    out += [(b + rng.normal(size=16) * s).tolist() for b, s in zip(base, np.linspace(0, 0.6, 60))]
    out += [out[0], out[0], [x * 3 for x in out[1]]]
    out += [(base[2] + rng.normal(size=16) * 0.05).tolist() for _ in range(80)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0]]
    return [(k, v) for k, v in enumerate(out + odd)] + [(None, out[0]), (3, out[3])]


def test_embedding_links(spark, monkeypatch):
    data = vectors()
    frame = spark.createDataFrame([(k, v, 1, 9) for k, v in data], "vec_id long, embedding array<double>, label int, id long")
    monkeypatch.setattr(embeddings, "BUCKET", 4)
    got = sorted(tuple(r) for r in embeddings.link_vectors(frame, recall=0.9999, block=16).collect() if r.vec_id is not None)
    good = [(k, np.array(v, float)) for k, v in data
            if k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = [(k, v / np.linalg.norm(v)) for k, v in good]
    links, root = [0] * len(unit), list(range(len(unit)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    order = sorted(range(len(unit)), key=lambda i: unit[i][0])
    for i in range(len(unit)):
        for j in range(len(unit)):
            if i != j and len(unit[i][1]) == len(unit[j][1]) and unit[i][1] @ unit[j][1] >= 0.9:
                links[i] += 1
                a, b = find(i), find(j)
                if unit[a][0] <= unit[b][0]:
                    root[b] = a
                else:
                    root[a] = b
    expected = [(unit[i][0], links[i], unit[find(i)][0], unit[i][0] == unit[find(i)][0]) for i in order]
    bad = {k for k, _ in data if k is not None} - {k for k, _ in good}
    assert got == sorted(expected + [(k, 0, k, True) for k in bad])
    assert max(links) > 50
    assert embeddings.link_vectors(frame.limit(0)).count() == 0


def test_rows_that_share_an_id_have_links_of_their_own(spark):
    data = [(5, [1.0, 0.0]), (5, [1.0, 0.01]), (6, [0.0, 1.0]), (7, [1.0, 0.02]), (6, [0.01, -1.0]), (4, [0.02, -1.0])]
    got = embeddings.link_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>"), recall=0.9999)
    assert sorted(tuple(r) for r in got.collect()) == [
        (4, 1, 4, True), (5, 2, 5, True), (5, 2, 5, True), (6, 0, 6, True), (6, 1, 4, False), (7, 2, 5, False)]


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    n = (1 << 4) + d
    machine = quality.FactorisationMachine(0.3, rng.normal(size=n), rng.normal(size=(n, 3)) * 0.1, np.zeros(d), np.ones(d), 4)
    text = "some words and some marks !!! here"
    b, v, s = quality.features(text, 5, {}, 4)
    i, x = np.concatenate([b, 16 + np.arange(d)]), np.concatenate([v, np.clip(s, -5, 5)])
    y = machine.bias + machine.weights[i] @ x
    for p in range(len(i)):
        for q in range(p + 1, len(i)):
            y += machine.factors[i[p]] @ machine.factors[i[q]] * x[p] * x[q]
    assert abs(machine.score(text, 5, {}) - 1 / (1 + np.exp(-y))) < 1e-9


def graded(spark, n=300):
    rng = random.Random(8)
    data, labels = [], []
    for k in range(n):
        good = k % 3 > 0
        text = sentence(rng, rng.randint(30, 120)) if good else " ".join(w.upper() + "###" for w in sentence(rng, 60).split())
        data.append((k, text, f"s{k % 4}"))
        labels.append((k, int(good), 0))
    odd = [(None if k is None else k + 1000, t, s) for k, t, s in rows(n=12)[12:]]
    return data + odd, spark.createDataFrame(labels + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")


def test_quality_on_the_held_out_fold(spark):
    data, labels = graded(spark)
    docs = documents(spark, data)
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(data)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    unseen = [r for r in got if r.held_out and r.doc_id < 300]
    assert len(unseen) > 30
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in unseen) / len(unseen) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_quality_without_labels_or_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_documents(documents(spark), labels).collect()} == {0.5}
    assert quality.score_documents(empty(spark), labels).count() == 0


def test_every_ordinary_paragraph_trains_or_calibrates(spark):
    lines = [f"plain line number w{k} of many" for k in range(40)]
    data = [(k, "\n".join(lines[k % 4::4] + ["", "Released under the MIT License."]), "s") for k in range(8)] + [(9, None, "s")]
    got = licenses.ordinary_paragraphs(documents(spark, data)).collect()
    assert {" ".join(r.ws): r.n for r in got} == {line: 2 for line in lines}
    assert {r.fit for r in got} == {True, False}


def test_paragraphs_search_a_text_once(spark, capsys):
    text = " \tOne, two\r\n\n--\nÄb ÇD\x0bE9_f\n x\n"
    data = [(1, text, "s"), (1, text, "s"), (None, "Solo", "s"), (3, None, "s"), (4, "", "s")]
    found = licenses.paragraphs(documents(spark, data)).collect()
    got = sorted((r["__key"]["id"] or 0, r["paragraph"], r["ws"]) for r in found)
    own = [(1, 0, ["one", "two"]), (1, 3, ["Äb", "Çd", "e9", "f"]), (1, 4, ["x"])]
    assert got == [(0, 0, ["solo"]), *sorted(own * 2)]
    licenses.ordinary_paragraphs(documents(spark, data)).explain()
    assert capsys.readouterr().out.count("translate(") == 1


def test_licences(spark):
    rng = random.Random(6)
    data = [(k, "\n".join(sentence(rng, 12) for _ in range(4)), "s") for k in range(200)]
    planted = {3: "Released under the MIT License.", 17: "licensed under the APACHE License, version 2.0",
               40: "This work is licensed under the GNU General Public License, version 3."}
    data = [(k, t + "\n" + planted[k] + "\n" if k in planted else t, s) for k, t, s in data]
    data += [(500, None, "s"), (501, "", "s"), (502, "License plates are licensed under the law of the city.", "s")]
    got = {r.doc_id: (r.n_licences, r.families) for r in licenses.licences(documents(spark, data)).collect()}
    assert len(got) == len(data)
    assert {k: v for k, v in got.items() if v[0]} == {3: (1, "MIT"), 17: (1, "Apache-2.0"), 40: (1, "GPL-3.0")}
    assert licenses.licences(empty(spark)).count() == 0


GNU = ("{} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as "
       "published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version.")
NAMED = [
    ("GPL-2.0", GNU.format("This program", ";", "", ";", "2")), ("GPL-3.0", GNU.format("This program", ":", "", ",", "3")),
    ("LGPL-2.1", GNU.format("This library", ";", "Lesser ", ";", "2.1")), ("LGPL-3.0", GNU.format("This library", ":", "Lesser ", ",", "3")),
    ("AGPL-3.0", GNU.format("This program", ":", "Affero ", ",", "3")),
    ("MIT", "This module is distributed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"), ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-or-later"),
    ("CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"), ("BSD-2-Clause", "# SPDX-License-Identifier: BSD-2-Clause"),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one\nor more contributor license agreements."),
    ("Zlib", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held "
             "liable for any damages\narising from the use of this software."),
    ("EPL-2.0", "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\n"
                "which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("", "This library is not licensed under the MIT License. All rights reserved."),
    ("", "It is no longer released under the MIT License."),
    ("", GNU.format("This program", ":", "", ",", "4")),
]


def test_licence_versions_tags_and_denials(spark):
    rng = random.Random(12)
    data = [(k, "\n".join(sentence(rng, 12) for _ in range(4)), "s") for k in range(200)]
    data += [(300 + k, "\n".join([sentence(rng, 9), text, sentence(rng, 9)]), "s") for k, (_, text) in enumerate(NAMED)]
    # A text of some megabytes, and repeated rows.
    data += [(400, "du " * 400_000 + "\n" + "lorem ipsum dolor\n" * 50_000 + "Released under the MIT License.", "s")]
    data += [(401, "Released under the MIT License.", "s")] * 3
    got = {r.doc_id: r.families for r in licenses.licences(documents(spark, data)).collect()}
    assert {k: got[300 + k] for k in range(len(NAMED))} == {k: family for k, (family, _) in enumerate(NAMED)}
    assert got[400] == got[401] == "MIT" and not any(got[k] for k in range(200))


MIT = """The MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """Copyright 2020 Some One. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

1. Redistributions of source code must retain the above copyright notice."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,"""


def test_wrapped_licences(spark):
    rng = random.Random(8)
    filler = lambda: "\n".join(sentence(rng, 12) for _ in range(4))
    data = [(k, filler(), "s") for k in range(150)]
    signs = ("{}", "// {}", " * {}", "# {}", "-- {}")
    notices = {"MIT": MIT, "BSD-3-Clause": BSD, "GPL-3.0": GPL}
    want = {}
    for family, notice in notices.items():
        for k, sign in enumerate(signs):
            text = "\n".join(sign.format(x) for x in notice.split("\n"))
            # Amid other text, with and without blank lines around it.
            data.append((200 + len(want), filler() + ("\n\n" if k % 2 else "\n") + text + "\n" + filler(), "s"))
            want[200 + len(want)] = (1, family)
    narrow = "\n".join(GPL.split("\n\n")[0].split())
    data += [(300, narrow, "s"), (301, GPL.replace("modify\n", "modify\n\n").replace("by\n", "by\n\n"), "s"),
             (302, MIT + "\n\n" + GPL + "\nReleased under the MIT License.\n" + BSD, "s")]
    want |= {300: (1, "GPL-3.0"), 302: (4, "BSD-3-Clause,GPL-3.0,MIT")}
    got = {r.doc_id: (r.n_licences, r.families) for r in licenses.licences(documents(spark, data)).collect()}
    assert len(got) == len(data) and {k: v for k, v in got.items() if v[0]} == want


def test_no_template_without_a_needed_word():
    needed = licenses._needed_words()
    for _, text in licenses.TEMPLATES:
        grams = licenses._plain_bigrams(text)
        without = [g for g in grams if not any(w in needed for w in g.split())]
        assert len(without) / len(grams) < licenses.CONFIRM


def test_stages_hand_on_documents(spark, tmp_path):
    data, labels = graded(spark, 120)
    docs = documents(spark, data).select("doc_id", "text", "lang", "source", "n_chars")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, data[1][1])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, work) in enumerate(corpus_pipeline.STAGES):
        out = work(spark, now, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/{k}")
        now = spark.read.parquet(f"{folder}/{k}")
        if name == "decontamination":
            assert now.where("doc_id = 1").count() == 0 and now.count() > 20
    assert now.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert corpus_pipeline.run(spark, folder).count() == now.count()
