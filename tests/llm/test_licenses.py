"""Licence scan against plain search of every phrase and a recursive reading of expressions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tablescope.llm import licenses
from tablescope.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.01"
PHRASES = [*licenses.BASE, *licenses.NOTICES, *licenses.TAGS]


def spoken(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def test_automaton_finds_every_phrase_in_pieces_and_rows():
    r = random.Random(3)
    phrases = ["a", "a b", "b a b", "a b a b a", "c a", "b b", "b a", "c c c"]
    machine = licenses.Automaton(phrases)
    rows = [[r.choice("abcd" if k % 3 else "abc") for _ in range(r.choice([0, 1, 2, 5, 40, 2000]))] for k in range(60)]
    words = [w for row in rows for w in row]
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    which, at = machine.search(machine.symbols(pa.array([w.encode() for w in words], pa.binary())), owner)
    want, base = [], 0
    for row in rows:
        want += [(base + i, k) for k, p in enumerate(phrases) for i in places(row, p)]
        base += len(row)
    assert list(zip(at.tolist(), which.tolist())) == sorted(want)


def plain_value(tokens):
    """Value of a whole expression by recursion: or, and, with; None if it isn't whole."""

    def either(at):
        value, at = both(at)
        while at < len(tokens) and tokens[at].upper() == "OR":
            other, at = both(at + 1)
            value = min(value, other)
        return value, at

    def both(at):
        value, at = one(at)
        while at < len(tokens) and tokens[at].upper() == "AND":
            other, at = one(at + 1)
            value = max(value, other)
        return value, at

    def one(at):
        if tokens[at] == "(":
            value, at = either(at + 1)
            assert tokens[at] == ")"
            at += 1
        else:
            assert tokens[at].upper() not in licenses.RANK and tokens[at] != ")"
            value, at = licenses.restriction(tokens[at]), at + 1
        while at < len(tokens) and tokens[at].upper() == "WITH":
            assert tokens[at + 1] not in ("(", ")")
            value, at = min(value, licenses.EXCEPTED), at + 2
        return value, at

    return either(0)[0]


def made(r, depth=0):
    kind = r.random()
    if depth > 3 or kind < 0.4:
        name = r.choice(["MIT", "GPL-3.0-or-later", "AGPL-3.0-only", "CC-BY-NC-4.0", "Other-1.0", "MPL-2.0"])
        return [name, "WITH", "Classpath-exception-2.0"] if r.random() < 0.2 else [name]
    if kind < 0.55:
        return ["(", *made(r, depth + 1), ")"]
    return [*made(r, depth + 1), r.choice(["OR", "AND", "or", "and"]), *made(r, depth + 1)]


def test_expressions_by_recursion():
    r = random.Random(9)
    for _ in range(800):
        tokens = made(r)
        names, written, value = licenses.evaluated(" " + " ".join(tokens) + " */")
        assert value == plain_value(tokens) and written == " ".join(tokens)
        assert set(names) == {t.lower() for k, t in enumerate(tokens) if t.upper() not in (*licenses.RANK, "(", ")") and (k == 0 or tokens[k - 1] != "WITH")}


@pytest.mark.parametrize(
    ("text", "names", "value"),
    [
        ("MIT", ["mit"], 0.2), ("MIT) see below", ["mit"], 0.2), ("MIT Apache-2.0", ["mit"], 0.2), ("GPL-2.0+ WITH x-exception", ["gpl-2.0+"], 0.5),
        ("", [], 0.6), ("MIT OR", ["mit"], 0.6), ("AND MIT", [], 0.6), ("(MIT", ["mit"], 0.6), ("()", [], 0.6), ("LicenseRef-Own", ["licenseref-own"], 0.6),
        ("mit or And", ["mit", "and"], 0.2), ("(" * 5000 + "MIT" + ")" * 5000, ["mit"], 0.2),
    ],
)
def test_odd_expressions(text, names, value):
    found = licenses.evaluated(text)
    assert (found[0], found[2]) == (names, value)


def plain_row(text):
    words = spoken(text)
    base = [(i, p) for p in licenses.BASE for i in places(words, p)]
    every = [(i, i + len(p.split()), p) for p in PHRASES if p not in licenses.TAGS for i in places(words, p)]
    outer = [(s, e, p) for s, e, p in every if not any(a <= s and e <= b and (a, b) != (s, e) for a, b, _ in every)]
    kinds = {**licenses.BASE, **licenses.NOTICES}
    labels = {kinds[p] for _, _, p in every}
    score = max([licenses.restriction(kinds[p]) for _, _, p in outer], default=0.0)
    for m in re.finditer(r"(?:spdx[^a-z0-9\n]license[^a-z0-9\n](?:identifier|expression)|license[^a-z0-9\n]expression)[ \t]*:([^\r\n]*)", text or "", re.I):
        names, _, value = licenses.evaluated(m[1])
        labels |= set(names)
        score = max(score, value)
    first = [i for i, _ in base]
    return len(words), len(base), min(first, default=None), max(first, default=None), ",".join(sorted({licenses.BASE[p] for _, p in base})), ",".join(sorted(labels)), score


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = QUERIES["op12_licenses"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rows = got.collect()
    assert len(rows) == len(docs) and {r.base_labels for r in rows} >= {"", "gpl", "cc-by", "reserved"}
    for r in rows:
        assert tuple(r)[1:] == plain_row(docs[r.doc_id])


def test_edges(spark):
    tag = "/* SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND CC-BY-NC-4.0 */\nno expression here"
    texts = [None, "", "...", "GNU Lesser General Public License", "CC BY-NC 4.0", "cc\nby", tag, "x: spdx license identifier", "a CC-BY" * 2, "spdx-license-identifier:", "all rights reserved " * 3000]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] * 2, "doc_id int, text string, labels string")
    got = licenses.scan(df).orderBy("doc_id").collect()[::2]
    assert [r.text for r in got] == texts and all(r.labels == "x" for r in got)
    assert [r.score for r in got] == [0, 0, 0, 0.5, 0.85, 0.2, 0.85, 0, 0.2, 0.6, 1.0]
    assert got[6].findings[0].expression == "(MIT OR GPL-2.0-only) AND CC-BY-NC-4.0" and got[6].findings[0].labels == ["mit", "gpl-2.0-only", "cc-by-nc-4.0"]
    assert [f.labels for f in got[3].findings] == [["lgpl"], ["gpl"]] and len(got[10].findings) == 3000
    for r, t in zip(got, texts):
        base = [f for f in r.findings if f.kind == "base"]
        assert (len(base), r.n_words) == (plain_row(t)[1], len(spoken(t)))
    assert licenses.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="score"):
        licenses.scan(df.withColumnRenamed("labels", "Score"))
