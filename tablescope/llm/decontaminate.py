"""Benchmark decontamination: find the words of documents that lie in passages of benchmark items.

Words are longest runs of digits, letters and characters beyond ASCII, A-Z lower-cased. An item's phrases are its windows of
13 words, or the whole item if it has fewer. Each shard of documents gets an FM-index over the words that occur in the
benchmark (runs too short to hold any phrase are left out, which loses no occurrence). All phrases are searched
backwards through wavelet ranks, located from sampled suffix positions, and their spans merged per document.

The benchmark goes to the tasks in blocks of bounded size; with several blocks the spans of a row are merged by its position.
Null text or text without words has no words and no hits; an item without words has no phrase; items that share an id count
once; a null id counts as an item named `null`. Rows are independent: repeated rows get a result each. Empty tables give
empty results, an empty benchmark hits nothing. Documents may have any further columns, but not those of the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.fm_index import FMIndex
from tablescope.llm.frames import tidy
from tablescope.llm.words import LETTERED, coded, raw, slices, split

WIDTH = 13
#: Text of benchmark items that a task gets at once; more items go in further blocks.
BLOCK_BYTES = 8 << 20
#: Text of documents that one index covers.
SHARD_BYTES = 1 << 20
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("stop", T.IntegerType(), False)]), False)


class Phrases:
    """The distinct phrases of a block of items as numbers of words, and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        words = split(pa.array([t for _, t in items], pa.string()), LETTERED, lower=True)
        codes, self.vocabulary = coded(words.array)
        found: dict[tuple, set[str]] = {}
        for row, (name, _) in enumerate(items):
            own = tuple((codes[words.offsets[row] : words.offsets[row + 1]] + 1).tolist())
            for at in range(max(1, len(own) - width + 1) if own else 0):
                found.setdefault(own[at : at + width], set()).add(name)
        self.items = [sorted(x) for x in found.values()]
        self.lengths = np.array([len(x) for x in found], np.int64)
        self.matrix = np.zeros((len(found), width), np.int64)
        for row, phrase in enumerate(found):
            self.matrix[row, : len(phrase)] = phrase


def spans_of_shard(texts: pa.Array, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, object]:
    """For each occurrence of a phrase: row, phrase, first word (within the shard) and length; and the words."""
    words = split(texts, LETTERED, lower=True)
    none = np.zeros(0, np.int64)
    if not len(phrases.lengths) or not len(words.array):
        return none, none, none, none, words
    codes, distinct = coded(words.array)


    known = pc.fill_null(pc.index_in(distinct, value_set=phrases.vocabulary), -1).to_numpy(zero_copy_only=False) + 1
    symbols = known[codes].astype(np.int64)
    rows = words.rows()
    # Runs of benchmark words inside one row, long enough for the shortest phrase.
    starts = symbols > 0
    starts[1:] &= (symbols[:-1] == 0) | (rows[1:] != rows[:-1])
    ends = symbols > 0
    ends[:-1] &= (symbols[1:] == 0) | (rows[1:] != rows[:-1])
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    long = last - first >= phrases.lengths.min()
    first, last = first[long], last[long]
    if not len(first):
        return none, none, none, none, words
    sizes = last - first + 1
    total = int(sizes.sum())
    begin = np.cumsum(sizes) - sizes
    origin = np.arange(total) - np.repeat(begin - first, sizes)
    sequence = np.zeros(total, np.int64)
    inside = np.ones(total, dtype=bool)
    inside[begin + sizes - 1] = False
    sequence[inside] = symbols[origin[inside]]
    index = FMIndex(sequence, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.matrix, phrases.lengths)
    counts = high - low
    which = np.repeat(np.arange(len(counts)), counts)
    places = index.locate(np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts - low, counts))
    word = origin[places]
    return rows[word], which, word, phrases.lengths[which], words


def _shard(texts: pa.Array, phrases: Phrases, remove: bool):
    rows, which, word, length, words = spans_of_shard(texts, phrases)
    n = len(words.offsets) - 1
    change = np.zeros(len(words.array) + 1, np.int64)
    np.add.at(change, word, 1)
    np.add.at(change, word + length, -1)
    hit = np.cumsum(change)[:-1] > 0
    # A span ends where hits end or a row ends.
    of = words.rows()
    opens, closes = hit.copy(), hit.copy()
    opens[1:] &= ~hit[:-1] | (of[1:] != of[:-1])
    closes[:-1] &= ~hit[1:] | (of[1:] != of[:-1])
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    cuts = np.searchsorted(of[first] if len(first) else first, np.arange(n + 1))
    base = words.offsets[of[first]] if len(first) else first
    spans = pa.ListArray.from_arrays(
        pa.array(cuts, pa.int32()),
        pa.StructArray.from_arrays([pa.array(first - base, pa.int32()), pa.array(last - base, pa.int32())], names=["start", "stop"]),
    )
    names: list[list[str]] = [[] for _ in range(n)]
    if len(rows):
        pairs = np.unique(rows * len(phrases.lengths) + which)
        found: dict[int, set[str]] = {}
        for pair in pairs.tolist():
            found.setdefault(pair // len(phrases.lengths), set()).update(phrases.items[pair % len(phrases.lengths)])
        for row, own in found.items():
            names[row] = sorted(own)
    columns = [pa.array(words.counts, pa.int64()), spans, pa.array(names, pa.list_(pa.string()))]
    if remove:
        data, offsets = raw(texts)
        keep = np.ones(len(data), dtype=bool)
        for a, b in zip(words.begin[first].tolist(), words.end[last - 1].tolist(), strict=True):
            keep[a:b] = False
        left = np.concatenate([[0], np.cumsum(keep)])[offsets]
        cleaned = pa.StringArray.from_buffers(n, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[keep])))
        columns.append(cleaned)
    return columns


def blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> list[DataFrame]:
    """The items in parts of about `limit` bytes of text at most."""
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text") * 4 + 64), F.lit(0)).alias("size")).first().size
    count = -(-size // limit) or 1
    return [items] if count == 1 else [items.where(F.pmod(F.xxhash64("item"), F.lit(count)) == k) for k in range(count)]


def find(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    width: int = WIDTH, cleaned: str | None = None, keep_text: bool = True, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All columns of `df`, its words `n_words`, the merged hit `spans` in words, and the `items` found, sorted.

    `cleaned` names a further column with the text without its hit spans. Without `keep_text` the text column is left out, so it
    does not travel back from the tasks.
    """
    added = ["n_words", "spans", "items", *([cleaned] if cleaned else [])]
    if clash := {c.lower() for c in df.columns} & {c.lower() for c in added}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    parts = blocks(benchmark, item, item_text, block_bytes)
    if len(parts) == 1:
        return _search(df, parts[0], text, width, cleaned, keep_text)
    from tablescope.plans.scratch import write_scratch

    # A row is known by its key in every pass; the text itself isn't shuffled.
    keyed = write_scratch(df.withColumn("_row", F.expr("uuid()")), "decontaminate")
    found = [_search(keyed.select("_row", text), x, text, width, None, False) for x in parts]
    rows = found[0]
    for other in found[1:]:
        rows = rows.unionAll(other)
    merged = rows.groupBy("_row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = F.aggregate(
        "spans",
        F.array().cast(SPANS),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["stop"] >= x["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], x["stop"]).alias("stop"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    kept = keyed if keep_text or cleaned else keyed.drop(text)
    rows = kept.join(merged.withColumn("spans", joined), "_row").drop("_row")
    return without_spans(rows, text, cleaned, keep_text) if cleaned else rows


def without_spans(df: DataFrame, text: str, cleaned: str, keep_text: bool = True) -> DataFrame:
    """All columns, and `cleaned`: the text without the words of its `spans` and what stands between these."""
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*kept, T.StructField(cleaned, T.StringType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, SHARD_BYTES):
                words = split(part.column(text), LETTERED, lower=True)
                data, offsets = raw(part.column(text))
                spans = part.column("spans")
                row = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
                first, last = (words.offsets[row] + spans.flatten().field(n).to_numpy(zero_copy_only=False) for n in ("start", "stop"))
                change = np.zeros(len(data) + 1, np.int64)
                np.add.at(change, words.begin[first], 1)
                np.add.at(change, words.end[last - 1], -1)
                keep = np.cumsum(change)[:-1] == 0
                left = np.concatenate([[0], np.cumsum(keep)])[offsets]
                found = pa.StringArray.from_buffers(part.num_rows, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[keep])))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), found], names=schema.names)

    return df.mapInArrow(tidy(run), schema)


def _search(df: DataFrame, block: DataFrame, text: str, width: int, cleaned: str | None, keep_text: bool) -> DataFrame:
    items = [(r.item, r.text) for r in block.collect()]  # bounded by the block size
    shared = df.sparkSession.sparkContext.broadcast(items)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
    fields += [T.StructField(cleaned, T.StringType())] if cleaned else []
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    names, schema = [f.name for f in kept], T.StructType([*kept, *fields])

    def run(batches):
        phrases = Phrases(shared.value, width)
        for batch in batches:
            for shard in slices(batch, text, SHARD_BYTES):
                yield pa.RecordBatch.from_arrays([*(shard.column(c) for c in names), *_shard(shard.column(text), phrases, bool(cleaned))], names=schema.names)

    return df.mapInArrow(tidy(run), schema)


def judged(found: DataFrame) -> DataFrame:
    """`find`'s rows with n_hit, n_items, items_sha256 and contaminated (5 % of the words or more are hit)."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["stop"] - x["start"]).cast("long"))
    return (
        found.withColumn("n_hit", hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        .withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))
    )
