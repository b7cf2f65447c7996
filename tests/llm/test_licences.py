import re

import pytest

from tunegauge.llm import licences


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
    finds = [(i, label) for phrase, label in licences.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(finds)


@pytest.mark.parametrize("text", [
    "", None, "Under the MIT License.", "under the mit license under the mit license", "CC BY-NC 4.0; cc-by-nc cc by nc by nc",
    "the Apache License, Version 2.0", "Apache License Version 20", "xunder the mit license", "é under\nthe\tMIT!license é", "under the mit license",
    "licensed under the under the MIT license and the Apache--License (Version) 2", "cc by cc by nc",
])
def test_base_places(text):
    n, finds, _, score = licences.scan(text)
    assert (n, sorted((w, label) for kind, w, _, label in finds if kind == "base")) == brute(text)
    assert 0 <= score <= 1


@pytest.mark.parametrize("text, postfix", [
    ("MIT", "mit"), ("MIT OR Apache-2.0 AND BSD-3-Clause", "mit apache-2.0 bsd-3-clause and or"),
    ("(MIT OR Apache-2.0) AND BSD", "mit apache-2.0 or bsd and"), ("GPL-2.0+ WITH Classpath-exception-2.0 OR MIT", "gpl-2.0+ classpath-exception-2.0 with mit or"),
    ("MIT OR", "mit"), ("(MIT OR X", ""), ("MIT Apache", "mit"), ("AND MIT", ""), (")", ""), ("((MIT))", "mit"), ("", ""), ("MIT) OR X", "mit"),
])
def test_expressions(text, postfix):
    assert " ".join(licences.parse(text)) == postfix


def test_ways_to_comply():
    ways = licences.evaluate(licences.parse("(a or b) and c with d"))
    assert ways == [frozenset({"a", "c with d"}), frozenset({"b", "c with d"})]
    many = licences.evaluate(licences.parse(" and ".join(f"(a{i} or b{i})" for i in range(12))))
    assert len(many) < 65 and set().union(*many) == {f"{x}{i}" for x in "ab" for i in range(12)}


def test_tags_and_rows(spark, odd, empty):
    got = licences.scanned(odd)
    assert got.count() == 12 and licences.scanned(empty).count() == 0
    rows = spark.createDataFrame([(1, "# SPDX-License-Identifier: MIT OR Apache-2.0\nx"), (2, "no licence"), (2, "SPDX-License-Identifier:")], "doc_id long, text string")
    found = licences.scanned(rows).collect()
    assert [(r.doc_id, r.expressions, r.licences, r.score) for r in found] == [(1, ["mit apache-2.0 or"], ["apache-2.0", "mit"], 1.0), (2, [], [], 0.3), (2, [], [], 0.3)]


def test_long_expressions_are_read_to_the_end_of_the_line():
    names = [f"LicenseRef-{i}-of-many" for i in range(300)]
    text = f"SPDX-License-Identifier: {' AND '.join(names)}\nAND other"
    assert len(text) > 5000
    _, _, expressions, _ = licences.scan(text)
    assert [x for x in expressions[0].split() if x != "and"] == [n.lower() for n in names]
