import re

from tallyloom.llm import licenses

LINES = {"GPL": "under the GNU General Public License, version", "CC-BY-NC": "under CC BY-NC", "MIT": "under the MIT License", "Apache": "under the Apache License, Version", "Proprietary": "All rights reserved"}


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = licenses.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = 0
    for r in licenses.scan(docs, model).collect():
        t = texts[r.doc_id]
        assert r.families == ",".join(sorted(f for f, s in LINES.items() if s in t))
        assert r.n_paragraphs == sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in t.split("\n"))
        for s in r.spans:
            found += 1
            assert LINES[s.family] in t.encode()[s.begin : s.end].decode()
    assert found > 10


def test_notices_and_lookalikes(spark, empty):
    rows = [
        (1, "Intro words.\n\n  Released under the BSD 3-Clause License.  \nmore", "BSD"),
        (2, "Licensed under CC BY-SA 4.0", "CC-BY"),
        (3, "the license under the version and the public work, licensed general", ""),
        (4, "We released the album under the old oak, in version two of the public park.", ""),
        (5, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.\nCopyright 2020 All rights reserved.", "MPL,Proprietary"),
        (6, None, ""),
        (61, "Licensed under the GNU Affero General Public License, version 3", "AGPL"),
        (62, "Intro.\nLicensed under the ISC License.\n", "ISC"),
        (7, "", ""),
        (None, "\n \n", ""),
        (8, "Somewhere inside a longer line this work is licensed under the GNU General Public License, version 3 and goes on", "GPL"),
    ]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], "doc_id long, text string, families string, n_notices int")
    model = licenses.fit(docs)
    assert {r.doc_id: r.families for r in licenses.scan(docs, model).collect()} == {i: f for i, _, f in rows}
    assert licenses.scan(empty, licenses.fit(empty)).collect() == []


def test_all_rights_reserved_alone(spark):
    texts = ["Intro.\nAll rights reserved.\nmore", "all rights reserved", "Copyright 2020 All rights reserved.", "The rights of all were reserved for later.", "Reserved rights all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(docs, licenses.fit(docs)).collect()}
    assert [rows[i].families for i in range(5)] == ["Proprietary"] * 3 + ["", ""]
    (span,) = rows[0].spans
    assert texts[0][span.begin : span.end] == "All rights reserved."
