"""Minimal keys of a table: the smallest groups of columns in which no two rows agree."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.columns import require_columns
from tablescope.functions.scalars import short_key
from tablescope.plans.scratch import release

#: Column groups that one job estimates, whose rows one job tags (four bytes a row and group on disk), that one job checks, and
#: that one looks for in a slice (the lowest bits of a hash tell the group); rows that one task hands on and that one compares
#: at once.
ESTIMATES_PER_JOB, TAGS_PER_JOB, CHECKS_PER_JOB, GROUPS_PER_JOB = 60, 2, 16, 256
CHUNK_ROWS, ROWS_PER_TASK = 1 << 17, 1 << 19
#: Places of the table of rows that may agree with another one; rows of a job from which on its shuffle files are given back
#: before the next one.
SUSPECTS, LARGE = 1 << 23, 1 << 24
#: log2 of a sketch's registers (a relative error of 0.8 %), and the share of the rows that a key's estimate reaches in any
#: case: some twelve deviations, beyond which an estimate does not err in practice.
SKETCH_LOG, REACHED = 14, 0.9
#: The part of the hash space in which duplicates are looked for first.
SLICE = 64
#: Values of a column from which on its slice is about as large as a slice of the rows.
VARIED = 100 * SLICE


def _parts(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    """The columns as they are compared: long texts by digest, so that they aren't shuffled."""
    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return [short_key(F.col(f"`{c}`")) if c in texts else F.col(f"`{c}`") for c in names]


def _estimates(df: DataFrame, groups: list[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """About how many different rows each group has, many groups in one read."""
    found = {}
    for at in range(0, len(groups), ESTIMATES_PER_JOB):
        own = groups[at : at + ESTIMATES_PER_JOB]
        sketches = [F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*_parts(df, g)), SKETCH_LOG)).alias(f"e{i}") for i, g in enumerate(own)]
        found |= dict(zip(own, df.agg(*sketches).first()))
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The places of those that are equal to another one in both, equal ones side by side."""
    order = np.argsort(a)
    same = np.zeros(len(a) + 1, dtype=bool)
    same[1:-1] = a[order[1:]] == a[order[:-1]]
    order = order[same[1:] | same[:-1]]
    order = order[np.lexsort((b[order], a[order]))]
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
    return order[same[1:] | same[:-1]]


def _chunks_of(batches):
    """The columns of the batches as arrays, many rows at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            yield {n: np.concatenate([x.column(n).to_numpy() for x in held]).view(np.uint64) for n in batch.schema.names}
            held, rows = [], 0
    if rows:
        yield {n: np.concatenate([x.column(n).to_numpy() for x in held]).view(np.uint64) for n in held[0].schema.names}


def _meeting(batches):
    """Packed rows (a, b) of a whole partition to the numbers of the groups in which two agree."""
    both = np.frombuffer(b"".join(x for batch in batches for x in batch.column("packed").to_pylist()), np.uint64).reshape(-1, 2)
    found = np.unique(both[_agreeing(both[:, 0], both[:, 1]), 1] & np.uint64(GROUPS_PER_JOB - 1))
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32))], names=["i"])


def _hashes(df: DataFrame, names: list[str], seconds: bool = True) -> DataFrame:
    """Two hashes (a0, b0 and so on), or the first one, of each of the columns."""
    parts = _parts(df, tuple(names))
    both = [F.xxhash64(F.lit("again"), p).alias(f"b{k}") for k, p in enumerate(parts)] if seconds else []
    return df.select(*[F.xxhash64(p).alias(f"a{k}") for k, p in enumerate(parts)], *both)


def _together(columns: dict[str, np.ndarray], which: str, places: list[int], rows=slice(None)) -> np.ndarray:
    """The hash of a group of columns, put together from those of the columns."""
    whole = np.zeros(1, np.uint64)
    for k in places:
        whole = _mixed(whole * np.uint64(31) + columns[f"{which}{k}"][rows])
    return whole


def _cells_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    """Equal hashes go to one cell, a range of them."""
    return ((hashes >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)


def _tags(hashes: np.ndarray) -> np.ndarray:
    """What is left of hashes to compare them inside a cell: bits that the cell does not tell."""
    return (hashes >> np.uint64(6)).astype(np.uint32)


def _suspect(cells: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """The place of rows in the table of suspects."""
    return (_mixed(cells.astype(np.uint64) << np.uint64(32) | tags) % np.uint64(SUSPECTS)).astype(np.int32)


def _packed(numbers: np.ndarray, cell: np.ndarray, payload: np.ndarray) -> pa.RecordBatch:
    """(cell, packed): the payload of ascending cells, as bytes."""
    begin = np.flatnonzero(np.diff(cell, prepend=-1))
    size = payload.nbytes // max(1, len(payload))
    ends = pa.py_buffer((np.append(begin, len(payload)) * size).astype(np.int32))
    packed = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, ends, pa.py_buffer(np.ascontiguousarray(payload))])
    return pa.RecordBatch.from_arrays([pa.array(numbers[begin]), packed], names=["cell", "packed"])


def _tags_again(batches):
    """Packed tags of a whole partition to the places of those that come twice in their cell."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for cell, packed in zip(batch.column("cell").to_pylist(), batch.column("packed").to_pylist()):
            held.setdefault(cell, []).append(packed)
    for cell, packed in held.items():
        tags = np.sort(np.frombuffer(b"".join(packed), np.uint32))
        twice = np.unique(tags[1:][tags[1:] == tags[:-1]])
        if len(twice):
            yield pa.RecordBatch.from_arrays([pa.array(_suspect(np.full(len(twice), cell), twice))], names=["place"])


def _suspects(df: DataFrame, groups: list[tuple[str, ...]], rows: int) -> np.ndarray:
    """A table of fixed size with the places of all rows that agree with another one in a group, and few others.

    Rows are compared by some forty bits, of which the cell tells those that grow with the rows, so that four bytes are shuffled
    for each. A few groups at a time are on disk.
    """
    known, cells = np.zeros(SUSPECTS, dtype=bool), 1 + rows // ROWS_PER_TASK
    for at in range(0, len(groups), TAGS_PER_JOB):
        own = groups[at : at + TAGS_PER_JOB]
        names = sorted({c for g in own for c in g})
        places = [[names.index(c) for c in g] for g in own]

        def run(batches, at=at, places=places):
            for columns in _chunks_of(batches):
                for i, group in enumerate(places, at):
                    hashes = np.sort(_together(columns, "a", group))
                    # Two of many equal ones are enough.
                    few = np.ones(len(hashes), dtype=bool)
                    few[2:] = hashes[2:] != hashes[:-2]
                    hashes = hashes[few]
                    cell = _cells_of(hashes, cells)
                    yield _packed(i * cells + cell, cell, _tags(hashes))

        spread = max(cells * len(own), df.sparkSession.sparkContext.defaultParallelism)
        tagged = _hashes(df, names, seconds=False).mapInArrow(run, "cell long, packed binary").repartition(spread, "cell")
        known[tagged.mapInArrow(_tags_again, "place int").distinct().toArrow().column("place").to_numpy()] = True
        del tagged
        if rows * len(own) > LARGE:
            release(df.sparkSession)
    return known


def _repeating(df: DataFrame, groups: list[tuple[str, ...]], pivots: dict[tuple[str, ...], str | None] | None, rows: int) -> set[tuple[str, ...]]:
    """The groups in which two rows agree; with `pivots`, among the rows of a slice of the hash space only: that of the
    group's pivot, a column of it, or of the whole group if there is none. Otherwise among all suspects.

    Rows are compared by 120 bits of hashes, put together from those of the columns, for many groups in one shuffle of packed
    hashes. A task that has seen two rows of a group agree hands on these and no more of the group.
    """
    found, step = set(), GROUPS_PER_JOB if pivots else CHECKS_PER_JOB
    known = None if pivots or not groups else df.sparkSession.sparkContext.broadcast(_suspects(df, groups, rows))
    if known is not None and not known.value.any():
        return found
    part = 1 / SLICE if known is None else known.value.mean()
    cells, tag_cells = 1 + int(rows * part) // ROWS_PER_TASK, 1 + rows // ROWS_PER_TASK
    for at in range(0, len(groups), step):
        own = groups[at : at + step]
        names = sorted({c for g in own for c in g})
        place = {c: k for k, c in enumerate(names)}
        hashed = _hashes(df, names)
        ways = [place.get(pivots[g]) for g in own] if pivots else []
        if pivots and None not in ways:
            hashed = hashed.where(reduce(Column.__or__, [F.pmod(f"a{k}", F.lit(SLICE)) == 0 for k in sorted(set(ways))]))

        def run(batches, at=at, places=[[place[c] for c in g] for g in own], ways=ways, known=known):
            left = list(range(len(places)))
            for columns in _chunks_of(batches):
                inside = {k: np.flatnonzero(columns[f"a{k}"] % np.uint64(SLICE) == 0) for k in {*ways} - {None}}
                for i in list(left):
                    which = inside.get(ways[i], slice(None)) if ways else slice(None)
                    a = _together(columns, "a", places[i], which)
                    chosen = slice(None)
                    if not ways:
                        chosen = known.value[_suspect((at + i) * tag_cells + _cells_of(a, tag_cells), _tags(a))]
                    elif ways[i] is None:
                        chosen = a % np.uint64(SLICE) == 0
                    a, b = a[chosen], _together(columns, "b", places[i], which)[chosen]
                    order = np.argsort(a)
                    both = np.stack([a[order], b[order] & ~np.uint64(GROUPS_PER_JOB - 1) | np.uint64(i)], axis=1)
                    if (both[1:, 0] == both[:-1, 0]).any() and len(two := _agreeing(both[:, 0], both[:, 1])[:2]):
                        both = both[two]
                        left.remove(i)
                    if len(both):
                        cell = _cells_of(both[:, 0], cells)
                        yield _packed(i * cells + cell, cell, both)

        spread = max(cells * len(own), df.sparkSession.sparkContext.defaultParallelism)
        met = hashed.mapInArrow(run, "cell long, packed binary").repartition(spread, "cell").mapInArrow(_meeting, "i int")
        found |= {own[r.i] for r in met.distinct().collect()}
        del met
        if rows * part * len(own) > LARGE:
            release(df.sparkSession)
    return found


def unique_keys(df: DataFrame, width: int = 3, columns: list[str] | None = None) -> DataFrame:
    """`columns array<string>, size int`: all minimal keys of at most `width` columns; nulls agree with each other.

    The groups of columns are gone through by size. A group that holds a known key isn't minimal. Where the estimated
    numbers of different values of its columns, multiplied, stay below the number of rows, or a column's own estimate does,
    two rows agree. What is left is checked exactly: first the rows of a sixty-fourth of the hash space of the group's column
    with most values, which hold all rows that agree with them, then all rows: two groups at a time by short tags, and those
    whose tag comes twice in full. `df` is read many times, so it should be stored.
    """
    names = require_columns(df, columns or df.columns)
    rows, keys = df.count(), []
    known: dict[str, float] = {}
    for size in range(1, width + 1):
        groups = [g for g in combinations(names, size) if not any(set(k) <= set(g) for k in keys)]
        room = rows * REACHED
        if size == 1:
            found = _estimates(df, groups)
            known = {c: n / REACHED for (c,), n in found.items()}
            groups = [g for g in groups if found[g] >= room]
        groups = [g for g in groups if prod(known[c] for c in g) >= room]
        widest = {g: max(g, key=known.get) for g in groups}
        pivots = {g: c if known[c] >= VARIED else None for g, c in widest.items()}
        for ways in (pivots, None):
            repeating = _repeating(df, groups, ways, rows)
            groups = [g for g in groups if g not in repeating]
        keys += groups
    listed = [(list(k), len(k)) for k in keys]
    return df.sparkSession.createDataFrame(listed, "columns array<string>, size int")
