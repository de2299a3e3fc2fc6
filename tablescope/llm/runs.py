"""Periodic runs: stretches of words that repeat with a period, found by a suffix automaton and link-cut access.

A run is a maximal stretch of consecutive words with smallest period q and at least max(`least`, 3 q) words. `find` returns
every run of every whole text and the text without what repeats: a word goes if a run holds it behind that run's first q words.

Every 8-word window of such a run stands in the text a second time, no further than q words away. So vectorised window
hashes first leave the stretches that can hold runs; a hash that collides only leaves more. The words of a stretch are appended
to a suffix automaton, whose links form a tree over all its substrings by their ends. Each appended word recolours the path
from its prefix to the root with its own place. The segments of one colour that it replaces tell, for each earlier end, the
longest common suffix; if that reaches back to the distance of the two ends, they are a square, and the squares with one
period and one start are a run. Segments are kept as stacks on the heavy paths of the tree, which gives the preferred paths of
link-cut access without rotations: recolouring takes O(log n) steps a word on average.

Null texts, empty texts and texts without words have no runs and become empty. Rows are independent; repeated rows get the
same result each. Empty tables give empty tables. Further columns are kept; names of the result are refused. Memory follows a
slice of a few MB, or some 500 bytes for each word of the longest periodic stretch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablescope.llm.words import SPACED, coded, mixed, slices, split, windows

#: Least words of a run, and how often its period fits at least.
LEAST, TIMES = 24, 3
#: Words of the windows that leave the candidate stretches. Any run is at least two periods and one window long.
WINDOW = 8
#: Rounds of narrowing the candidates; more only save time.
ROUNDS = 8
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


class SuffixTree:
    """Link tree of the suffix automaton of a sequence: parent and longest substring of each state, state of each prefix."""

    def __init__(self, sequence: list[int]):
        parent, size, follow, self.prefix = [-1], [0], [{}], []
        last = 0
        for symbol in sequence:
            new = len(size)
            size.append(size[last] + 1)
            follow.append({})
            parent.append(0)
            state = last
            while state >= 0 and symbol not in follow[state]:
                follow[state][symbol] = new
                state = parent[state]
            if state >= 0:
                target = follow[state][symbol]
                if size[target] == size[state] + 1:
                    parent[new] = target
                else:
                    copy = len(size)
                    size.append(size[state] + 1)
                    follow.append(follow[target].copy())
                    parent.append(parent[target])
                    parent[target] = parent[new] = copy
                    while state >= 0 and follow[state].get(symbol) == target:
                        follow[state][symbol] = copy
                        state = parent[state]
            self.prefix.append(new)
            last = new
        self.parent, self.size = parent, size

    def heads(self) -> list[int]:
        """The first state of each state's heavy path."""
        parent = self.parent
        order = np.argsort(np.array(self.size), kind="stable").tolist()
        weight, heavy = [1] * len(parent), [0] * len(parent)
        most = [0] * len(parent)
        for state in reversed(order[1:]):
            above, own = parent[state], weight[state]
            weight[above] += own
            if own > most[above]:
                most[above], heavy[above] = own, state
        head = [0] * len(parent)
        for state in order[1:]:
            above = parent[state]
            head[state] = head[above] if above and heavy[above] == state else state
        return head


def squares(sequence: list[int]) -> dict[tuple[int, int], int]:
    """(first word, period) of every maximal repetition of two periods or more, with its last word."""
    tree = SuffixTree(sequence)
    parent, size, head = tree.parent, tree.size, tree.heads()
    # Of each heavy path: (longest substring of the deepest state, last end) of each segment, the one next to the root last.
    paths: dict[int, list[tuple[int, int]]] = {}
    found = {}
    for place, state in enumerate(tree.prefix):
        before = -1
        while state:
            path = paths.setdefault(head[state], [])
            deep = size[state]
            nearest = path[-1][1] if path else before
            done = 0
            while path and done < deep:
                bottom, end = path[-1]
                if bottom <= deep:
                    path.pop()
                    done = bottom
                else:
                    done = deep
                # A segment that goes on from the path below was looked at there.
                if end != before and done >= place - end:
                    period = place - end
                    found[place - done - period + 1, period] = place
            path.append((deep, place))
            before = nearest
            state = parent[head[state]]
    return found


def runs_of(sequence: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    every = ((start, last - start + 1, period) for (start, period), last in squares(sequence).items())
    return sorted(((s, n, p) for s, n, p in every if n >= max(least, times * p)), key=lambda x: (x[0], x[2]))


def stretches(codes: np.ndarray, rows: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the stretches that hold all runs, given the words of all rows as numbers and their rows."""
    none = np.zeros(0, np.int64)
    hashes = windows(mixed(codes.astype(np.uint64) + np.uint64(1)), WINDOW)
    if not len(hashes):
        return none, none
    at = np.flatnonzero(rows[: len(hashes)] == rows[WINDOW - 1 :])
    keys = mixed(hashes[at] ^ mixed(rows[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    gaps = np.where(same, np.diff(at[order]), len(codes))
    near = np.full(len(at), len(codes), np.int64)
    near[order[1:]] = gaps
    near[order[:-1]] = np.minimum(near[order[:-1]], gaps)
    left = np.flatnonzero(near < len(codes))
    at, near = at[left], near[left]
    for _ in range(ROUNDS):
        if not len(at):
            return none, none
        cut = np.flatnonzero((np.diff(at) > 1) | (rows[at[1:]] != rows[at[:-1]]))
        first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut + 1, [len(at)]])
        words = last - first + WINDOW - 1
        room = np.repeat(np.where(words >= least, words, 0), last - first)
        keep = near * times <= room
        if keep.all():
            break
        at, near = at[keep], near[keep]
    if not len(at):
        return none, none
    cut = np.flatnonzero((np.diff(at) > 1) | (rows[at[1:]] != rows[at[:-1]]))
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut + 1, [len(at)]])
    begin, end = at[first], at[last - 1] + WINDOW
    long = end - begin >= least
    return begin[long], end[long]


def _slice(texts: pa.Array, least: int, times: int) -> list[pa.Array]:
    words = split(texts, SPACED)
    codes, _ = coded(words.array)
    rows, n = words.rows(), len(texts)
    keep = np.ones(len(codes), dtype=bool)
    found, owner = [], []
    for begin, end in zip(*(x.tolist() for x in stretches(codes, rows, least, times))):
        row = int(rows[begin])
        base = begin - int(words.offsets[row])
        for start, length, period in runs_of(codes[begin:end].tolist(), least, times):
            found.append((base + start, length, period))
            owner.append(row)
            keep[begin + start + period : begin + start + length] = False
    table = np.array(found, np.int64).reshape(-1, 3)
    cuts = np.searchsorted(np.array(owner, np.int64), np.arange(n + 1))
    runs = pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], names=["start", "length", "period"])
    left = np.concatenate([[0], np.cumsum(keep)])[words.offsets]
    kept = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.array.filter(pa.array(keep)))
    collapsed = pc.binary_join(kept, b" ").cast(pa.string())
    return [pa.array(words.counts, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), runs), collapsed]


def find(df: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES, keep_text: bool = True) -> DataFrame:
    """All columns of `df`, the words `n_words`, the `runs` by start, then period, and the `collapsed` text.

    Words are longest stretches without ASCII white space. Without `keep_text` the text is left out.
    """
    if clash := {c.lower() for c in df.columns} & {"n_words", "runs", "collapsed"}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    if times < 3 or least < 3 * WINDOW:
        raise ValueError(f"at least 3 periods and {3 * WINDOW} words are asked of a run")
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    schema, names = T.StructType([*kept, *added]), [f.name for f in kept]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *_slice(part.column(text), least, times)], names=schema.names)

    return df.mapInArrow(run, schema)
