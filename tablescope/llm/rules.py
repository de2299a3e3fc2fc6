"""Quality rules: an isolation forest over rule statistics of whole texts.

`statistics` counts, per text, words, their characters, symbols, repeated lines, words in repeated 8-word windows and a few
more. Trees of random splits are grown on a bounded sample of labelled rows: splits fall anywhere in the range of the sample,
and a branch without good rows ends, so rows unlike the good ones have short paths. The mean path length over all trees gives
the anomaly score, and the highest score that is still kept is calibrated over all labelled rows: as many low-quality rows as
possible go while at most `lost` of the good ones do. Rows that fail the base rules never pass.

Null and empty texts have no words and fail. Rows are independent (repeated rows are judged alike, each). Without labelled
rows of both kinds the forest rejects nothing. Labels with a null id or null label are left out; a document with several
labels counts with each. Empty tables give empty tables. Columns of `df` other than id and text are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.frames import smallest_hashes
from tablescope.llm.words import SPACED, coded, mixed, raw, slices, split, windows
from tablescope.plans.scratch import write_scratch

REPEAT_WIDTH = 8
#: Labelled rows that trees may be grown on, at most; the rows with the smallest hashes of their ids.
FIT_ROWS = 20_000
TREES, TREE_ROWS, DEPTH = 300, 256, 10
#: Share of good labelled rows that the threshold may lose.
LOST = 0.005
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")

SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
UPPER = np.isin(np.arange(256), list(range(0x41, 0x5B)))
DIGIT = np.isin(np.arange(256), list(range(0x30, 0x3A)))
MARK = np.isin(np.arange(256), list(b"!?"))
FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80


def counts_of(texts: pa.Array) -> list[np.ndarray]:
    """COUNTS of each text."""
    data, offsets = raw(texts)
    n = len(offsets) - 1

    def total(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])

    words = split(texts, SPACED)
    codes, _ = coded(words.array)
    rows = words.rows()
    inside = SPACED[data]
    lines = split(texts, np.arange(256) != 0x0A)
    filled = np.concatenate([[0], np.cumsum(inside)])
    spoken = filled[lines.end] > filled[lines.begin]
    line_codes, distinct = coded(lines.array)
    keys = (lines.rows() * (len(distinct) + 1) + line_codes)[spoken]
    line_rows = lines.rows()[spoken]
    n_lines = np.bincount(line_rows, minlength=n)
    first_rows = np.unique(keys) // (len(distinct) + 1)
    repeated_lines = n_lines - np.bincount(first_rows.astype(np.int64), minlength=n)

    covered = np.zeros(len(codes) + 1, np.int64)
    seen = windows(mixed(codes.astype(np.uint64) + np.uint64(1)), REPEAT_WIDTH)
    if len(seen):
        whole = rows[: len(seen)] == rows[REPEAT_WIDTH - 1 :]
        at = np.flatnonzero(whole)
        found = mixed(seen[at] ^ mixed(rows[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(found, kind="stable")
        same = found[order][1:] == found[order][:-1]
        twice = np.zeros(len(found), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        begin = at[order[twice]]
        np.add.at(covered, begin, 1)
        np.add.at(covered, begin + REPEAT_WIDTH, -1)
    repeated = np.cumsum(covered)[:-1] > 0
    kinds = np.unique(rows * (int(codes.max(initial=0)) + 1) + codes) // (int(codes.max(initial=0)) + 1)
    return [
        words.counts, total(inside & FIRST_BYTE[data]), total(SYMBOL[data]), repeated_lines,
        np.bincount(rows[repeated], minlength=n), n_lines, total(UPPER[data]), total(DIGIT[data]), total(MARK[data]),
        np.bincount(kinds.astype(np.int64), minlength=n),
    ]


def statistics(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and COUNTS of each whole text."""
    kind = dict(df.dtypes)[doc]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                columns = [pa.array(x, pa.int64()) for x in counts_of(part.column(text))]
                yield pa.RecordBatch.from_arrays([part.column(doc), *columns], names=["doc_id", *COUNTS])

    return df.select(doc, text).mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{c} long" for c in COUNTS)]))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Square roots of rates, one row per document; twenty usual words are added, so that short texts have no wild rates."""
    c = {k: np.asarray(v, np.float64) for k, v in counts.items()}
    words, chars, lines = c["n_words"] + 20, c["word_chars"] + 100, c["n_lines"] + 3
    rates = [c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_upper"] / chars, c["n_marks"] / words, chars / words]
    return np.sqrt(np.column_stack(rates))


def usual_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search in a random tree over n rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), (n == 2) * 1.0)


@dataclass
class Forest:
    """Trees as arrays: split column (-1: leaf), split value, left child (the right one follows), path length at leaves."""

    column: np.ndarray
    value: np.ndarray
    child: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    usual: float

    @staticmethod
    def grown(usual: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, depth: int = DEPTH, seed: int = 7) -> Forest:
        """Splits are random in the box from `low` to `high`; `usual` rows say where a box is worth splitting further."""
        random = np.random.default_rng(seed)
        column, value, child, length, roots = [], [], [], [], []
        arrays = (column, value, child, length)
        size = min(tree_rows, len(usual))
        for _ in range(trees):
            roots.append(len(column))
            for x in arrays:
                x.append(0)
            todo = [(roots[-1], usual[random.choice(len(usual), size, replace=False)], low, high, 0)]
            while todo:
                node, own, floor, ceiling, level = todo.pop()
                usable = np.flatnonzero(ceiling > floor)
                if level >= depth or not len(own) or not len(usable):
                    column[node], length[node] = -1, level + float(usual_path(len(own)))
                    continue
                c = int(random.choice(usable))
                cut = random.uniform(floor[c], ceiling[c])
                left = len(column)
                for x in arrays:
                    x.extend([0, 0])
                column[node], value[node], child[node] = c, cut, left
                under, below, above = own[:, c] < cut, ceiling.copy(), floor.copy()
                below[c] = above[c] = cut
                todo += [(left, own[under], floor, below, level + 1), (left + 1, own[~under], above, ceiling, level + 1)]
        return Forest(np.array(column), np.array(value, np.float64), np.array(child), np.array(length, np.float64), np.array(roots), float(usual_path(size)) or 1.0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score of each row, 0 to 1, rounded to four decimals."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            while True:
                inner = self.column[node] >= 0
                if not inner.any():
                    break
                at = every[inner]
                here = node[inner]
                node[inner] = self.child[here] + (rows[at, self.column[here]] >= self.value[here])
            total += self.length[node]
        return np.round(2.0 ** (-total / len(self.roots) / self.usual), 4)


def base_failed():
    return F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")


def cut_of(histogram: list[tuple[float, int, int]], lost: float) -> float:
    """The score above which rows go, from (score, good rows, bad rows): most bad rows within the loss, then fewest good."""
    good = sum(x[1] for x in histogram)
    bad = sum(x[2] for x in histogram)
    if not good or not bad:
        return 1.0
    best, gone_good, gone_bad, cut = 0, 0, 0, 1.0
    for score, g, b in sorted(histogram, reverse=True):
        gone_good, gone_bad = gone_good + g, gone_bad + b
        if gone_good > lost * good:
            break
        if gone_bad > best:
            best, cut = gone_bad, np.nextafter(score, 0)
    return float(cut)


def judge(
    df: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, lost: float = LOST
) -> DataFrame:
    """doc_id, COUNTS, base_failed, the anomaly score and kept. Labels: doc_id, quality (1 good, 0 bad)."""
    counted = write_scratch(statistics(df, doc, text).withColumn("base_failed", base_failed()), "rules")
    known = labels.select(F.col("doc_id").alias("_doc"), F.col("quality").alias("_quality")).where("_doc IS NOT NULL AND _quality IS NOT NULL")
    passing = counted.where(~F.col("base_failed"))
    labelled = write_scratch(passing.join(known, F.col("doc_id") == F.col("_doc")).drop("_doc"), "labelled")
    sample = smallest_hashes(labelled, ["doc_id", "_quality"], fit_rows).toPandas()  # bounded by fit_rows
    rows, good = features({c: sample[c].to_numpy() for c in COUNTS}), (sample["_quality"] == 1).to_numpy(bool)
    if not good.any() or good.all():
        return counted.withColumn("score", F.lit(0.0)).withColumn("kept", ~F.col("base_failed"))
    forest = df.sparkSession.sparkContext.broadcast(Forest.grown(rows[good], rows.min(axis=0), rows.max(axis=0)))

    def scored(rows: DataFrame) -> DataFrame:
        names = rows.columns

        def run(batches):
            for batch in batches:
                found = forest.value.score(features({c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS}))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*names, "score"])

        return rows.mapInArrow(run, ", ".join([*(f"{n} {k}" for n, k in rows.dtypes), "score double"]))

    # One row per rounded score: four decimals bound it.
    groups = scored(labelled).groupBy("score").agg(F.count_if(F.col("_quality") == 1).alias("good"), F.count_if(F.col("_quality") == 0).alias("bad"))
    cut = cut_of([(r.score, r.good, r.bad) for r in groups.collect()], lost)
    return scored(counted).withColumn("kept", ~F.col("base_failed") & (F.col("score") <= F.lit(cut)))
