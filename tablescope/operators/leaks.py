"""Original values that survive in free text, found in one pass over the texts and an equality join.

A value stands in a text if one of the text's windows of the value's length equals it. Windows are told by rolling hashes of
their bytes: sums of bytes times powers of an odd number, taken from prefix sums, so every window of one length costs a
subtraction. A filter of the values' hashes, of a size that follows their number up to a fixed limit, passes few others; what it
passes is joined with the values by its text, which is exact. A value of more than `LONGEST` bytes is told by its first
`LONGEST` bytes and then looked for in the texts that hold these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.plans.scratch import write_scratch

#: Bytes of the longest window.
LONGEST = 64
#: Filter bits per value, and at most (128 MB); with more values more windows go to the join, and none is lost.
BITS_PER_VALUE, MOST_BITS = 64, 1 << 30
PROBES = 4
#: Bytes of text that are looked at together.
SLICE_BYTES = 2 << 20

BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins and the last ends; a null is empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


class Rolling:
    """Hashes of windows of a byte string."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        self.power = np.cumprod(np.full(n, BASE, np.uint64))
        back = np.cumprod(np.full(n, BACK, np.uint64))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * back[:-1], out=self.sums[1:])

    def windows(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        hashes = (self.sums[at + length] - self.sums[at]) * self.power[at + length - 1]
        return _mixed(hashes + np.asarray(length).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The filter bits of each hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [((hashes + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64) for k in range(PROBES)]


def _lead(length: np.ndarray) -> np.ndarray:
    """The largest power of two that isn't longer."""
    return 1 << (np.frexp(length.astype(np.float64))[1] - 1).astype(np.int64)


def _filter_words(values: DataFrame, bits: int) -> DataFrame:
    """(word, mask): the filter's words with set bits, for each value's first bytes and for the whole of its window."""

    def run(batches):
        for batch in batches:
            data, offsets = _bytes(batch.column("value"))
            length = np.minimum(np.diff(offsets), LONGEST)
            at, length = offsets[:-1][length > 0], length[length > 0]
            rolling = Rolling(data)
            set_bits = np.unique(np.concatenate([p for n in (_lead(length), length) for p in _places(rolling.windows(at, n), bits)]))
            words, first = np.unique(set_bits >> 6, return_index=True)
            masks = np.bitwise_or.reduceat(np.uint64(1) << (set_bits & 63).astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(masks.view(np.int64))], names=["word", "mask"])

    return values.select("value").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))


def text_leaks(texts: DataFrame, key: str, text: str, values: DataFrame, value: str, least: int = 4) -> DataFrame:
    """(`key`, value): every text and every distinct value of at least `least` characters that it holds, each pair once.

    `key` must be unique. Shorter values stand in most texts by chance; null values and null texts hold nothing. The
    values never pass the driver; the filter does, and its size is bounded.
    """
    wanted = values.select(F.col(value).cast("string").alias("value")).where(F.length("value") >= max(least, 1)).distinct()
    wanted = write_scratch(wanted, "values")
    facts = wanted.agg(F.count("*").alias("n"), F.collect_set(F.least(F.octet_length("value"), F.lit(LONGEST))).alias("lengths")).first()
    kind = dict(texts.dtypes)[key]
    given = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if not facts.n:
        return given.limit(0).select(F.col("key").alias(key), F.col("text").alias("value"))
    bits = min(MOST_BITS, 1 << max(16, int(np.ceil(np.log2(facts.n * BITS_PER_VALUE)))))
    table = np.zeros(bits >> 6, np.uint64)
    found = _filter_words(wanted, bits).toArrow()  # at most bits / 64 rows, of a bounded filter
    table[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(table)
    lengths = np.array(sorted(facts.lengths), np.int64)  # at most LONGEST of them

    def holds(hashes: np.ndarray) -> np.ndarray:
        left = np.arange(len(hashes))
        for place in _places(hashes, bits):
            place = place[left]
            left = left[(shared.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1]
        return left

    def windows(column: pa.Array):
        """Row and text of the windows that the filter passes, each once a row."""
        data, offsets = _bytes(column)
        rolling = Rolling(data)
        # How far a window may reach from each byte, as it ends with its text.
        room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
        for lead in np.unique(_lead(lengths)).tolist():
            at = np.flatnonzero(room >= lead)
            at = at[holds(rolling.windows(at, lead))]
            for length in lengths[_lead(lengths) == lead].tolist():
                own = at[room[at] >= length]
                own = own[holds(rolling.windows(own, length))] if length > lead else own
                if len(own):
                    # One of each equal windows of a text.
                    row = np.searchsorted(offsets, own, side="right") - 1
                    once = np.unique(np.stack([row.astype(np.uint64), rolling.windows(own, length)]), axis=1, return_index=True)[1]
                    own, row = own[once], row[once]
                    yield row, pa.array([data[a : a + length].tobytes() for a in own.tolist()], pa.binary())

    def run(batches):
        for batch in batches:
            column, keys = batch.column("text"), batch.column("key")
            ends = _bytes(column)[1]
            start = 0
            while start < len(column):
                stop = int(np.searchsorted(ends, ends[start] + SLICE_BYTES, side="right")) - 1
                stop = min(max(stop, start + 1), len(column))
                for row, found in windows(column.slice(start, stop - start)):
                    yield pa.RecordBatch.from_arrays([keys.slice(start).take(pa.array(row)), found], names=["key", "window"])
                start = stop

    windows_found = given.mapInArrow(run, f"key {kind}, window binary")
    lead = F.substring(F.col("value").cast("binary"), 1, LONGEST)
    named = wanted.select("value", lead.alias("window"), (F.octet_length("value") > LONGEST).alias("long"))
    met = windows_found.join(named, "window").select("key", "value", "long")
    short = met.where("NOT long").select("key", "value")
    long = met.where("long").distinct().join(given, "key").where(F.contains("text", "value")).select("key", "value")
    return short.unionAll(long).distinct().select(F.col("key").alias(key), "value")
