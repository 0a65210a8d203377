"""Base phrases against a plain search, rules on notices of our own, suppression, edge cases."""

import itertools
import random
import re
import time

import pytest

from tessera.llm import license_rules
from tessera.llm.license_scan import LOWER, WORD, Intervals, scan, scanner
from tessera.llm.queries import op4_license_scan


def found(spark, *texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    return [r for r in scan(docs).orderBy("doc_id").collect()]


def test_there_are_hundreds_of_rules_and_each_has_its_keyword():
    rules = license_rules.rules()
    assert len(rules) > 300 and [r.priority for r in rules] == sorted(r.priority for r in rules)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", {"mit"}),
        ("Licensed under the Apache License, Version 2.0.", {"apache-2"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3"}),
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc"}),
        ("licensed under CC-BY-NC-SA 4.0", {"cc-by-nc-sa"}),
        ("SPDX-License-Identifier: LGPL-2.1", {"lgpl-2.1"}),
        ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}),
        ("free and unencumbered software released into the public domain", {"unlicense"}),
        ("you may commit under the terms of an agreement", set()),
        ("mit der Zeit; the apache helicopter", set()),
    ],
)
def test_notices(spark, text, labels):
    (row,) = found(spark, text)
    assert {d.label for d in row.found} == labels
    assert (row.score > 0) == bool(labels or row.base)


def strings(parsed):
    """All strings of a pattern of literals, sets, groups and repeats, these at most twice."""
    out = [""]
    for kind, arg in parsed:
        name = str(kind)
        if name == "LITERAL":
            some = [chr(arg)]
        elif name == "IN":
            some = [chr(v) for _, x in arg for v in (x if isinstance(x, tuple) else (x,))]  # the ends of a range
        elif name == "ANY":
            some = ["x"]
        elif name == "BRANCH":
            some = [x for part in arg[1] for x in strings(part)]
        elif name == "SUBPATTERN":
            some = strings(arg[-1])
        elif name == "MAX_REPEAT":
            one = strings(arg[2])
            some = [x for n in range(arg[0], min(arg[1], 2) + 1) for x in map("".join, itertools.product(one, repeat=n))]
        else:
            assert name == "ASSERT"
            continue
        out = [a + b for a in out for b in some]
    return out


def test_gate_never_rejects_a_match():
    """Scans with the words of a text and with all keywords agree on each string of each name and rule of its own."""
    own = scanner()
    every = {w for r in own.rules for w in r.keywords} | {b[1] for b in own.base}
    texts = {x for _, _, name, _ in license_rules.NAMES for x in strings(re._parser.parse(name))}
    texts |= {x for *_, text in license_rules.TEXTS for x in strings(re._parser.parse(text))}
    assert len(texts) > 500 and {"apache2", "gpl2", "general public license version 2", "university of illinois"} <= texts
    for text in sorted(texts):
        line = f"{text} x license {text}"
        gated = own.scan(line, set(line.split()) & every)
        assert gated == own.scan(line, every), text
        assert gated[1], text
    for r in own.rules:  # also each rule alone, as another may hide it
        for x in strings(re._parser.parse(r.pattern.pattern))[::7]:
            assert r.keywords & set(x.split()), (r.label, x)


def test_edges(spark):
    rows = found(spark, None, "", "cc by nc by nc cc by nc", "x " * 100_000 + "under the MIT license")
    assert [(r.n_words, len(r.base), r.score) for r in rows[:2]] == [(0, 0, 0.0)] * 2
    assert [(d.start, d.end) for d in rows[2].base] == [(0, 3), (5, 8)]
    assert [(d.start, d.end) for d in rows[3].base] == [(100_000, 100_004)]
    assert scan(spark.createDataFrame([], "text string")).count() == 0


def test_suppression():
    base, got = scanner().scan("licensed under the cc by nc sa license and cc by nc", {"cc"})
    assert [(d[0], d[1]) for d in got] == [("cc-by-nc-sa", 0), ("cc-by-nc", 9)]
    assert base == []


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    some = 0
    for r in op4_license_scan(spark, sf_dir).collect():
        words = WORD.findall(texts[r.doc_id].translate(LOWER))
        places = []
        for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
            p = phrase.split()
            places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
        at = [i for i, _ in places]
        want = (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        some += len(places)
    assert some


def test_spans_are_whole_words():
    """Strings of every rule glued to letters on either side, and within a text: no span is empty or cuts a word."""
    own = scanner()
    every = {w for r in own.rules for w in r.keywords} | {b[1] for b in own.base}
    for r in own.rules:
        for x in strings(re._parser.parse(r.pattern.pattern))[::5]:
            for text in (f"ne{x}", f"{x}er", f"a {x}1999 b", f"q {x} z"):
                line = f" {' '.join(text.split())} "
                for m in r.pattern.finditer(line):
                    assert m.end() > m.start() and line[m.start() - 1] == " " == line[m.end()] and line[m.start()] != " " != line[m.end() - 1], (r.label, text)
    assert [d[:3] for d in own.scan("eula nebeula x", every)[1]] == [("proprietary", 0, 1)]
    assert [d[:3] for d in own.scan("server side public license 1999", every)[1]] == [("sspl", 0, 4)]  # the name, not "license 1"


def test_intervals_against_all_pairs():
    rng = random.Random(4)
    for _ in range(300):
        taken, plain = Intervals(), []
        for _ in range(40):
            a = rng.randrange(30)
            b = a + rng.randrange(1, 9)
            free = not any(x <= a and b <= y for x, y in plain)
            assert taken.add(a, b) == free
            if free:
                plain.append((a, b))


def test_long_text_of_many_notices():
    text = "licensed under the mit license, or the apache license version 2.0; spdx license identifier gpl 2; cc by nc 4.0. " * 9000  # about 1 MB
    own = scanner()
    keywords = {"mit", "apache", "gpl", "cc", "nc"}
    short = own.scan(text[: len(text) // 10], keywords)
    began = time.process_time()
    base, found = own.scan(text, keywords)
    assert len(base) == 10 * len(short[0]) and len(found) >= 9 * len(short[1])
    assert time.process_time() - began < 20
