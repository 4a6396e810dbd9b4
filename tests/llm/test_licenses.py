import random

import duckdb

from panelflow.llm import licenses


def test_licences_in_other_dress(spark, odd_docs, no_docs):
    mit = licenses.LICENSES["MIT"]
    rows = [
        (1, mit),
        (2, "MIT License\n\nCopyright (c) 2019-2024 Some Body <a@b.example>\n\n" + mit.upper().replace(" ", "\n ").replace('"', "“")),
        (3, mit + " And more."),
        (4, licenses.LICENSES["0BSD"].replace("performance", "performance").replace("DATA OR", "data, or")),
        (5, "The MIT License"),
        (6, licenses.LICENSES["MIT"].replace("sublicense", "sublicence").replace("NONINFRINGEMENT", "NON-INFRINGEMENT")),
        (7, None),
        (7, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", licenses.F.lit("x"))
    got = sorted((r["doc_id"], r["license"]) for r in licenses.scan(df).collect())
    assert got == [(1, "MIT"), (2, "MIT"), (3, None), (4, "0BSD"), (5, None), (6, "MIT"), (7, None), (7, None)]
    assert licenses.scan(odd_docs).count() == odd_docs.count()
    assert licenses.scan(no_docs).collect() == []


def test_known_digests_differ(spark):
    rows = licenses.known(spark).collect()
    assert len({r["known_digest"] for r in rows}) == len(rows)


HEADS = [
    "",
    "MIT License Copyright (c) 2020 Jane Doe ",
    "The MIT License (MIT) https://opensource.org/licenses/MIT\n\n  * Copyright 2020 J. Doe, Acme Inc. and others. All Rights Reserved.\n",
    "(c) 2019-2024 Best Ltd. of the north.  ",
    "BSD 3-Clause License the ISC License\n© 2020 Jane <j@d.example>\n",
    "// Copyright (c) 2020 Jane. (c) 2021 Joe. ",
    "The MIT License is short. ",
    "Permit license of 2020 (c) Jane\n",
]


def test_sql_agrees(spark, odd_docs):
    """Over odd rows, each known text behind each kind of claim, and mixtures of the claims' pieces."""
    pieces = ["copyright", "(c)", "©", " 2020", "jane", " ", " ", ". ", ", ", "\n", "\t", "inc", "best", "zinc.", "all rights reserved", "the ", "mit license", "isc license", " (mit)", " https://a.b/c", "permission is granted", "this software", "you may", "bsd 3-clause license", "use of this", "per", "\ue000", "\ue002"]
    choose = random.Random(3).choice
    mixed = ["".join(choose(pieces) for _ in range(choose((4, 9, 20)))) for _ in range(20_000)]
    planted = [head + form for head in HEADS for text in licenses.LICENSES.values() for form in (text, text.upper(), " ".join(text.split()), text + " And more.")]
    planted += [form for text in licenses.packed().values() for form in (text, " ".join(text.split()))]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(planted + mixed, 1000)), "doc_id long, text string"))
    db = duckdb.connect()
    db.register("documents", docs.toArrow())
    want = db.sql(licenses.scan_sql()).fetchall()
    got = [(r["doc_id"], r["digest"], r["license"]) for r in licenses.scan(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    found = {r[0]: r[2] for r in got}
    assert all(found[1000 + len(planted) - 1 - i] for i in range(2 * len(licenses.packed())))
    assert len({found[1000 + i] for i in range(len(HEADS) * len(licenses.LICENSES) * 4)} - {None}) == len(licenses.LICENSES)


def test_claims_on_the_line_of_their_licence(spark):
    """Of a text on one line only the claim goes."""
    heads = ["", "MIT License Copyright (c) 2020 Jane Doe ", "Copyright (c) 2019-2024, J. R. Doe, Acme Inc. and others. All rights reserved. ", "© 2020 Jane <j@d.example> ", "The MIT License (MIT)\n\nCopyright 2020 J. Doe\n"]
    rows = [(name, head + " ".join(text.split())) for name, text in licenses.LICENSES.items() for head in heads]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == len(rows) and [r for r in got if r["license"] != r["doc_id"]] == []


def test_other_text_behind_a_claim_stays(spark):
    texts = ["Copyright (c) 2020 Jane. An essay of two words.", "An essay of two words.", "The MIT License is short.", "", "Copyright (c) 2020 J. Doe", "MIT License\nAll rights reserved.", "Mit Licensed is no title"]
    got = {r["text"]: r["c"].split() for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", licenses.canonical(licenses.F.col("text")).alias("c")).collect()}
    assert got[texts[0]] == got[texts[1]] == "an essay of two words".split()
    assert got[texts[2]] == "the mit license is short".split() and got[texts[6]] == "mit licensed is no title".split()
    assert got[texts[3]] == got[texts[4]] == got[texts[5]] == []


def test_whole_texts_and_tags_are_known(spark):
    texts = licenses.packed()
    whole = {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"}
    assert whole <= set(texts)
    rows = [(k, form) for k in sorted(whole) for form in (texts[k], texts[k].upper(), " ".join(texts[k].split()))]
    rows += [("AGPL-3.0-only-tag", "SPDX-License-Identifier: AGPL-3.0-only"), ("MIT-notice", "SPDX-License-Identifier: MIT")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [r for r in got if r["license"] != r["doc_id"]] == []
    assert len({r["known_digest"] for r in licenses.known(spark).collect()}) == licenses.known(spark).count() > 500


def test_other_scripts_have_digests_of_their_own(spark):
    """Letters of any script are words, whatever their case; only texts of the same words share a digest."""
    rows = [(1, "漢字 文書"), (2, "別の 文書"), (3, "ΑΒΓ δεζ"), (4, "αβγ, ΔΕΖ!"), (5, "«Größe»"), (6, "größe"), (7, "…"), (8, None)]
    got = {r["doc_id"]: r["digest"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] != got[2] and got[3] == got[4] and got[5] == got[6] and got[7] == got[8]
    assert len(set(got.values())) == 5
