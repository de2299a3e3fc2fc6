"""Licence scan: identifier tags and notice phrases found by one automaton, licence expressions evaluated.

An Aho-Corasick automaton over words (digits, letters and characters beyond ASCII, A-Z lower-cased) finds all phrases in one
pass: base phrases, notices of known licences and the words of identifier tags. Its table of steps is dense, and many stretches
of text walk through it side by side. Behind a tag and a colon stands an expression such as `(MIT OR GPL-2.0-only WITH
Classpath-exception-2.0) AND BSD-3-Clause`; a shunting-yard parser (with before and before or) turns it into a sequence that
is evaluated to a restriction between 0 and 1: `or` takes the freer side, `and` the stricter one, `with` bounds the licence
by the restriction of one with a linking exception. It ends before the first token that cannot follow. An expression that is
empty or lacks an operand or a bracket counts as an unknown licence; the identifiers in it are still named.

`score` is the highest restriction found (0: nothing found). A notice inside a longer notice doesn't count for the score; base
phrases stay findings wherever they stand. Null, empty and wordless texts have no findings. Rows are independent; repeated
rows get the same result each. Empty tables give empty tables. Further columns are kept; names of the result are refused.
"""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablescope.llm.words import LETTERED, coded, raw, slices, split

# Phrases and the licences that they stand for.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "affero general public license": "agpl",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "artistic license": "artistic",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "gnu free documentation license": "gfdl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "no part of this publication may be reproduced": "reserved",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
    "zlib license": "zlib",
}
#: Words of a tag; a colon and an expression must follow.
TAGS = ("spdx license identifier", "spdx license expression", "license expression")
#: Restriction by licence family; further words of an identifier (version, only, or-later) don't count.
FAMILIES = {
    "0bsd": 0.05, "agpl": 0.8, "apache": 0.2, "artistic": 0.4, "bsd": 0.2, "bsl": 0.2, "cc-by": 0.2, "cc-by-nc": 0.85, "cc-by-nc-nd": 0.95,
    "cc-by-nc-sa": 0.85, "cc-by-nd": 0.85, "cc-by-sa": 0.5, "cc0": 0.05, "epl": 0.5, "eupl": 0.6, "gfdl": 0.7, "gpl": 0.7, "isc": 0.2,
    "lgpl": 0.5, "mit": 0.2, "mit-0": 0.05, "mpl": 0.5, "public-domain": 0.05, "reserved": 1.0, "unlicense": 0.05, "zlib": 0.2,
}
#: Restriction of a licence that isn't listed, and of one with a linking exception at most.
UNKNOWN, EXCEPTED = 0.6, 0.5

#: Words of a piece of text that walks through the automaton in one go.
PIECE = 256
TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
RANK = {"OR": 1, "AND": 2, "WITH": 3}
FINDING = T.StructType([
    T.StructField("kind", T.StringType(), False), T.StructField("labels", T.ArrayType(T.StringType(), False), False),
    T.StructField("first_word", T.LongType(), False), T.StructField("n_words", T.LongType(), False),
    T.StructField("expression", T.StringType()), T.StructField("restriction", T.DoubleType(), False),
])


class Automaton:
    """Aho-Corasick over words: dense steps by state and symbol (0: a word of no phrase), phrases that end in each state."""

    def __init__(self, phrases: list[str]):
        self.phrases = [p.split() for p in phrases]
        self.vocabulary = sorted({w for p in self.phrases for w in p})
        number = {w: k + 1 for k, w in enumerate(self.vocabulary)}
        children, own = [{}], [[]]
        for which, phrase in enumerate(self.phrases):
            state = 0
            for word in phrase:
                if number[word] not in children[state]:
                    children[state][number[word]] = len(children)
                    children.append({})
                    own.append([])
                state = children[state][number[word]]
            own[state].append(which)
        self.step = np.zeros((len(children), len(number) + 1), np.int32)
        fall, todo = [0] * len(children), deque([0])
        while todo:
            state = todo.popleft()
            if state:
                self.step[state] = self.step[fall[state]]
                own[state] += own[fall[state]]
            for symbol, child in children[state].items():
                fall[child] = int(self.step[state, symbol]) if state else 0
                self.step[state, symbol] = child
                todo.append(child)
        self.size = np.array([len(p) for p in self.phrases], np.int64)
        self.count = np.array([len(x) for x in own], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.own = np.array([x for found in own for x in found], np.int64)

    def symbols(self, words: pa.Array) -> np.ndarray:
        codes, distinct = coded(words)
        values = pa.array([w.encode() for w in self.vocabulary], pa.binary())
        return pc.fill_null(pc.index_in(distinct, value_set=values), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes] + 1

    def search(self, symbols: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and first word of every occurrence inside one row, by first word, then phrase."""
        none = np.zeros(0, np.int64)
        inside = symbols > 0
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1] | (rows[1:] != rows[:-1])
        ends[:-1] &= ~inside[1:] | (rows[1:] != rows[:-1])
        begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        long = end - begin >= self.size.min(initial=1)
        begin, end = begin[long], end[long]
        if not len(begin):
            return none, none
        # Long stretches go in pieces; each starts so many words earlier that its state is right where its own words begin.
        pieces = -(-(end - begin) // PIECE)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        own = np.repeat(begin, pieces) + nth * PIECE
        until = np.minimum(own + PIECE, np.repeat(end, pieces))
        at = np.maximum(own - int(self.size.max()), np.repeat(begin, pieces))
        order = np.argsort(at - until, kind="stable")
        at, own, until = at[order], own[order], until[order]
        length = until - at
        state = np.zeros(len(at), np.int32)
        found, place = [none], [none]
        for t in range(int(length[0])):
            active = int(np.searchsorted(-length, -t))
            state[:active] = self.step[state[:active], symbols[at[:active] + t]]
            hit = np.flatnonzero((self.count[state[:active]] > 0) & (at[:active] + t >= own[:active]))
            if len(hit):
                many = self.count[state[hit]]
                nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                which = self.own[np.repeat(self.first[state[hit]], many) + nth]
                found.append(which)
                place.append(np.repeat(at[hit] + t + 1, many) - self.size[which])
        found, place = np.concatenate(found), np.concatenate(place)
        order = np.lexsort((found, place))
        return found[order], place[order]


def restriction(identifier: str) -> float:
    """Restriction of one licence identifier."""
    name = identifier.lower().rstrip("+")
    parts = name.split("-")
    return next((FAMILIES["-".join(parts[:k])] for k in range(len(parts), 0, -1) if "-".join(parts[:k]) in FAMILIES), UNKNOWN)


def parsed(text: str) -> tuple[list[str], str, bool]:
    """The expression at the start of `text` with operators behind their operands, as it was written, and if it is whole."""
    output, waiting, due, at = [], [], True, 0
    while match := TOKEN.match(text, at):
        token = match[1]
        operator = token.upper() if token in (token.upper(), token.lower()) and token.upper() in RANK else None
        if operator:
            if due:
                break
            while waiting and waiting[-1] != "(" and RANK[waiting[-1]] >= RANK[operator]:
                output.append(waiting.pop())
            waiting.append(operator)
            due = True
        elif token == ")":
            if due or "(" not in waiting:
                break
            while (top := waiting.pop()) != "(":
                output.append(top)
        elif not due:
            break
        elif token == "(":
            waiting.append(token)
        else:
            output.append(token)
            due = False
        at = match.end()
    return output + [x for x in reversed(waiting) if x != "("], text[:at].strip(), not due and "(" not in waiting


def evaluated(text: str) -> tuple[list[str], str, float]:
    """Licence identifiers of the expression at the start of `text`, the expression, and its restriction."""
    sequence, written, whole = parsed(text)
    names, stack = [], []
    for token in sequence:
        if token not in RANK:
            stack.append((restriction(token), len(names)))
            names.append(token.lower())
        elif len(stack) > 1:
            right, left = stack.pop(), stack.pop()
            if token == "WITH":
                names[right[1]] = None
                stack.append((min(left[0], EXCEPTED), left[1]))
            else:
                stack.append(((min if token == "OR" else max)(left[0], right[0]), left[1]))
    return [n for n in dict.fromkeys(names) if n], written, stack[0][0] if whole and stack else UNKNOWN


def automaton() -> tuple[Automaton, list[tuple[str, str]]]:
    """The automaton of all phrases, and kind and label of each."""
    kinds = [("base", label) for label in BASE.values()] + [("notice", label) for label in NOTICES.values()] + [("tag", "") for _ in TAGS]
    return Automaton([*BASE, *NOTICES, *TAGS]), kinds


def findings(texts: pa.Array, machine: Automaton, kinds: list[tuple[str, str]]) -> tuple[np.ndarray, list[list[dict]], list[float]]:
    """Words, findings and score of each text."""
    words = split(texts, LETTERED, lower=True)
    rows = words.rows()
    which, place = machine.search(machine.symbols(words.array), rows)
    data, offsets = raw(texts)
    found: list[list[dict]] = [[] for _ in range(len(texts))]
    score = [0.0] * len(texts)
    if len(which):
        size = machine.size[which]
        # Inside a longer one: something that starts no later ends no earlier.
        until = place + size
        order = np.lexsort((-until, place))
        reach = np.maximum.accumulate(until[order])
        inner = np.zeros(len(which), dtype=bool)
        inner[order[1:]] = until[order[1:]] <= reach[:-1]
        for k, (one, first, n) in enumerate(zip(which.tolist(), place.tolist(), size.tolist())):
            kind, label = kinds[one]
            row, labels, expression, value = int(rows[first]), [label], None, FAMILIES.get(label) or restriction(label)
            if kind == "tag":
                if inner[k]:
                    continue
                begin, stop = int(words.end[first + n - 1]), int(offsets[row + 1])
                line = re.match(rb"[ \t]*:[^\r\n]*", memoryview(data[begin:stop]))
                if not line:
                    continue
                labels, expression, value = evaluated(line[0].decode().split(":", 1)[1])
            found[row].append({"kind": kind, "labels": labels, "first_word": first - int(words.offsets[row]), "n_words": n, "expression": expression, "restriction": value})
            if not inner[k]:
                score[row] = max(score[row], value)
    return words.counts, found, score


def scan(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns of `df`, the words `n_words`, the `findings` by first word, and the `score`.

    A finding has its kind (base, notice, tag), its labels, its first word and number of words, and for a tag the expression.
    Without `keep_text` the text is left out.
    """
    if clash := {c.lower() for c in df.columns} & {"n_words", "findings", "score"}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    added = [T.StructField("n_words", T.LongType()), T.StructField("findings", T.ArrayType(FINDING, False)), T.StructField("score", T.DoubleType())]
    schema, names = T.StructType([*kept, *added]), [f.name for f in kept]

    def run(batches):
        machine, kinds = automaton()
        fields = [("kind", pa.string()), ("labels", pa.list_(pa.string())), ("first_word", pa.int64()), ("n_words", pa.int64()), ("expression", pa.string()), ("restriction", pa.float64())]
        listed = pa.list_(pa.struct(fields))
        for batch in batches:
            for part in slices(batch, text):
                counts, found, score = findings(part.column(text), machine, kinds)
                columns = [pa.array(counts, pa.int64()), pa.array(found, listed), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns], names=schema.names)

    return df.mapInArrow(run, schema)
