"""N-gram Jaccard self-join by prefixes of the rarest shingles.

A text's set are the hashes of its distinct shingles (A-Z lower-cased words; a text of fewer words, but not none, is one shingle).
Two sets link when 100 * intersection >= percent * union. Equal sets collapse to one node before anything is compared.

All sets are ordered alike: by how often a shingle's cell of a count sketch of fixed size occurs in the corpus, rare ones first.
The first shingle that two sets share comes early in both: sets of n >= m shingles that link share at least
percent * (n + m) / (100 + percent) of them, so it is no later than so many before the end. The smaller set is found by its first
n - ceil(2 * percent * n / (100 + percent)) + 1 shingles (its short prefix), the larger one looks for it with a longer prefix.
Sizes fall into bands so that linked sets are in the same or the next band. A signature is a shingle and a band; every set stands
with the prefix of its own band and looks for smaller partners in the one below. The order decides the cost only: any
one order that all sets share loses no link, whatever the sketch holds.

Rows that share a signature form a bucket. Each bucket is streamed in sorted order and every member is paired with its first
short prefix only, so pairs grow with the rows; crowded buckets are salted and their first short prefixes paired again. Histograms of
the sets rule out most pairs that can't link (their difference is a lower bound); the others are verified on the whole sets, unless their sets are in one component by then. Where a bucket still spans several components, further members are
paired with those of other components: twice as many in each round, or all as soon as no more pairs are left than rows, until every short prefix of such a bucket has met all others: no link is lost.

Null texts and texts without words have an empty set and link with nothing. Repeated rows and equal texts share a component; a null
id is left out of a component's smallest id unless no other is there. Empty tables give empty results, further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.components import components
from tablescope.llm.frames import release, small_batches, tidy
from tablescope.llm.words import SPACED, hashed, mixed, raw, row_windows, slices, split
from tablescope.plans.scratch import write_scratch

#: Cells of the count sketch; rows of one bucket beyond which it is salted.
CELLS, CROWDED = 1 << 17, 100_000
#: Longs of the filter over nodes that have candidates.
FILTER_WORDS = 1 << 17
#: A round takes all pairs that are left if these are no more for each row of the open buckets, or no more in all.
ROW_PAIRS, ROUND_PAIRS = 1, 100_000
#: Signatures that a task hands on at once, and bytes of sets that it compares at once.
HANDED, COMPARED = 100_000, 2 << 20
#: Text that is cut into sets at once.
PART_BYTES = 1 << 20
#: Parts in which pairs are verified, and pairs that are verified in one go.
PARTS, ONE_PART = 4, 20_000

ELEMENT = np.uint64((1 << 48) - 1)
#: A member of a bucket is a node and its part: within its short prefix (no bit), or beyond it. The former sort first.
BEYOND = 1 << 62
NODE = (1 << 61) - 1


def allowed(total: np.ndarray | int, percent: int) -> np.ndarray | int:
    """At most so many shingles may differ between linked sets whose sizes sum up to `total`."""
    return total * (100 - percent) // (100 + percent)


def band_starts(largest: int, percent: int) -> np.ndarray:
    """First size of each band, up to the one beyond `largest`; a linked set is at most one band away."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(max(starts[-1] + 1, -(-100 * starts[-1] // percent)))
    return np.array([*starts, max(starts[-1] + 1, -(-100 * starts[-1] // percent))], np.int64)


class Sets:
    """Sets of the rows of one slice: sorted 48-bit elements, row by row."""

    def __init__(self, texts: pa.Array, width: int):
        words = split(texts, SPACED, lower=True)
        found, rows, _ = row_windows(words, hashed(words.array), width)
        keys = np.sort((rows.astype(np.uint64) << np.uint64(48)) | (found >> np.uint64(16)))
        keys = keys[np.diff(keys, prepend=~keys[:1]) != 0] if len(keys) else keys
        self.elements = keys & ELEMENT
        self.rows = (keys >> np.uint64(48)).astype(np.int64)
        self.sizes = np.bincount(self.rows, minlength=len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit names of each set; the first one, without its outer bits, is the node."""
        data, cuts = self.elements.tobytes(), (self.offsets * 8).tolist()
        both = [xxhash.xxh3_128_intdigest(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        first = np.array([x & (2**64 - 1) for x in both], np.uint64)
        return (first & np.uint64(NODE)).astype(np.int64), np.array([x >> 65 for x in both], np.int64)

    def packed(self, which: np.ndarray) -> pa.Array:
        """The sets of some rows, six bytes an element."""
        flat = np.ascontiguousarray(self.elements.view(np.uint8).reshape(-1, 8)[:, :6])
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.sizes), [None, pa.py_buffer(self.offsets * 6), pa.py_buffer(flat)])
        return whole.take(pa.array(which)).cast(pa.binary())


def cell_of(elements: np.ndarray) -> np.ndarray:
    """The cell of the count sketch of each element."""
    return (elements & np.uint64(CELLS - 1)).astype(np.int64)


def places(sets: Sets, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements of the sets in `rows` (ascending), rare ones first, with the index into `rows` and the place in the set of each."""
    chosen = np.full(len(sets.sizes), -1, np.int64)
    chosen[rows] = np.arange(len(rows))
    of = chosen[sets.rows]
    elements, of = sets.elements[of >= 0], of[of >= 0]
    often = np.minimum(counts[cell_of(elements)], (1 << 24) - 1).astype(np.uint64)
    # Elements ascend in each row, so a stable sort leaves equal keys in one order in all sets.
    key = (of.astype(np.uint64) << np.uint64(48)) | (often << np.uint64(24)) | (mixed(elements) & np.uint64((1 << 24) - 1))
    order = np.argsort(key, kind="stable")
    sizes = sets.sizes[rows]
    return elements[order], of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def prefix(sizes: np.ndarray, least: np.ndarray, percent: int) -> np.ndarray:
    """The first shingle that sets of these sizes share with linked ones of `least` shingles or more is among so many."""
    return sizes - -(-percent * (sizes + least) // (100 + percent)) + 1


def signatures(sets: Sets, rows: np.ndarray, nodes: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, members (node and part) and elements of the prefixes of the sets in `rows`."""
    rows = rows[sets.sizes[rows] > 0]
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = band_starts(int(sets.sizes[rows].max()), percent)
    sizes, node = sets.sizes[rows], nodes[rows]
    band = np.searchsorted(starts, sizes, side="right") - 1
    element, of, place = places(sets, rows, counts)
    early = place < prefix(sizes, sizes, percent)[of]
    own = place < prefix(sizes, starts[band], percent)[of]
    # The smallest partner has percent of the size; no smaller band holds one.
    least = -(-percent * sizes // 100)
    below = (place < prefix(sizes, least, percent)[of]) & (least < starts[band])[of]
    found, members = [], []
    for which, beneath in ((own, 0), (below, 1)):
        found.append(mixed(element[which] + ((band[of[which]] - beneath).astype(np.uint64) << np.uint64(48))))
        members.append(node[of[which]] | np.where(early[which] & (beneath == 0), 0, BEYOND))
    return np.concatenate(found), np.concatenate(members), np.concatenate([element[own], element[below]])


def _first_pass(width: int, names: list[str]):
    """Size and names of each row's set; at a task's end the cells of its shingles."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        cells, kind = np.zeros(CELLS, np.int64), None
        for batch in batches:
            kind = batch.column("doc").type
            for part in slices(batch, "text", PART_BYTES):
                sets = Sets(part.column("text"), width)
                node, other = sets.names()
                cells += np.bincount(cell_of(sets.elements), minlength=CELLS)
                blank = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(sets.sizes, pa.int64()), pa.array(node), pa.array(other), blank, blank], names=names)
        used = np.flatnonzero(cells)
        if len(used):
            blank = pa.nulls(len(used), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(used), kind), blank, blank, blank, pa.array(used), pa.array(cells[used])], names=names)

    return run


def _signature_pass(width: int, percent: int, shared, crowded: int):
    """(bucket, sig, member) for each distinct set of a slice; sig only where the bucket is a salted part of it."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        # What a cell holds beyond the usual is taken for one shingle.
        usual = int(np.median(counts))
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                sets = Sets(part.column("text"), width)
                nodes, _ = sets.names()
                rows = np.sort(np.unique(nodes, return_index=True)[1])
                found, members, elements = signatures(sets, rows, nodes, counts, percent)
                crowd = counts[cell_of(elements)] - usual
                hot = crowd > crowded
                bucket = found.copy()
                if hot.any():
                    salt = mixed((members[hot] & NODE).astype(np.uint64)) % (crowd[hot] // crowded + 1).astype(np.uint64)
                    bucket[hot] = mixed(found[hot] + mixed(salt + np.uint64(1)))
                for at in range(0, len(found), HANDED):
                    own = slice(at, at + HANDED)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket[own].view(np.int64)), pa.array(found[own].view(np.int64), mask=~hot[own]), pa.array(members[own])],
                        names=["bucket", "sig", "member"],
                    )

    return run


def _stars(batches) -> Iterator[pa.RecordBatch]:
    """Sorted rows (bucket, sig, member) to (sig, pivot, member, salted): each other member with its bucket's first one.

    Rows of one bucket may go on over many batches; only its first and its last member are remembered. A salted bucket has its
    first member for a pivot whatever its part is, and also gives it with itself.
    """
    bucket = pivot = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        buckets = batch.column("bucket").to_numpy(zero_copy_only=False)
        members = batch.column("member").to_numpy(zero_copy_only=False)
        fresh = np.ones(len(buckets), dtype=bool)
        fresh[1:] = buckets[1:] != buckets[:-1]
        fresh[0] = bucket is None or buckets[0] != bucket
        again = np.zeros(len(buckets), dtype=bool)
        again[1:] = (members[1:] == members[:-1]) & ~fresh[1:]
        again[0] = not fresh[0] and members[0] == last
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(buckets)), -1))
        pivots = np.where(at >= 0, members[np.maximum(at, 0)], 0 if pivot is None else pivot)
        bucket, pivot, last = buckets[-1], pivots[-1], members[-1]
        salted = np.asarray(batch.column("sig").is_valid())
        early = salted | (pivots < BEYOND)
        keep = np.flatnonzero(early & ((~again & ((pivots & NODE) != (members & NODE))) | (salted & fresh)))
        if len(keep):
            sig = np.where(salted, batch.column("sig").fill_null(0).to_numpy(zero_copy_only=False), buckets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig[keep]), pa.array(pivots[keep]), pa.array(members[keep]), pa.array(salted[keep])], names=["sig", "pivot", "member", "salted"]
            )


def _set_pass(width: int, shared):
    """(node, elements) of the distinct sets of each slice that the filter lets through."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                sets = Sets(part.column("text"), width)
                nodes, _ = sets.names()
                rows = np.sort(np.unique(nodes, return_index=True)[1])
                rows = rows[let_through(shared.value, nodes[rows]) & (sets.sizes[rows] > 0)]
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[rows]), sets.packed(rows)], names=["node", "elements"])

    return run


def let_through(words: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Which nodes a filter knows."""
    bit = nodes % (FILTER_WORDS * 64)
    return (words.view(np.uint64)[bit // 64] >> (bit % 64).astype(np.uint64) & np.uint64(1)) > 0


def _sifted(shared):
    """The rows whose node the filter knows."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.flatnonzero(let_through(shared.value, batch.column("node").to_numpy(zero_copy_only=False)))
            if len(rows):
                yield batch if len(rows) == batch.num_rows else batch.take(pa.array(rows))

    return run


def filter_of(nodes: DataFrame) -> np.ndarray:
    """A filter of fixed size over a column `node`, put together by an aggregate of at most FILTER_WORDS rows."""
    bit = F.col("node") % F.lit(FILTER_WORDS * 64)
    words = nodes.select(F.floor(bit / 64).cast("int").alias("word"), (bit % 64).cast("int").alias("bit"))
    found = words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    filled = np.zeros(FILTER_WORDS, np.int64)
    filled[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return filled


def histogram(elements: np.ndarray) -> np.ndarray:
    """Elements of a set per cell, 255 at most; as many cells as a power of two that is at least half the size, 256 or more."""
    cells = 1 << max(8, int(len(elements) // 2).bit_length())
    return np.minimum(np.bincount((elements & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8)


def least_difference(one: np.ndarray, other: np.ndarray) -> int:
    """A lower bound for the elements that are in one set only, from the histograms of two sets."""
    one, other = one.astype(np.int64), other.astype(np.int64)
    while len(one) > len(other):
        one = one.reshape(2, -1).sum(axis=0)
    while len(other) > len(one):
        other = other.reshape(2, -1).sum(axis=0)
    return int(np.abs(one - other).sum())


def _histogram_pass(batches) -> Iterator[pa.RecordBatch]:
    """(node, elements) to (node, size, cells)."""
    for batch in batches:
        for part in slices(batch, "elements", COMPARED):
            elements, sizes = _unpacked(part.column("elements"))
            ends = np.cumsum(sizes)
            cells = [histogram(elements[a:b] & ELEMENT).tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sizes, pa.int64()), pa.array(cells, pa.binary())], names=["node", "size", "cells"])


def _possible(percent: int):
    """Rows (a, b, left_size, right_size, left, right) to the pairs (a, b) that their histograms don't rule out."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("left_size").to_numpy(zero_copy_only=False) + batch.column("right_size").to_numpy(zero_copy_only=False)
            most = allowed(sizes, percent)
            (left, left_cuts), (right, right_cuts) = raw(batch.column("left")), raw(batch.column("right"))
            keep = [
                k for k in range(batch.num_rows)
                if least_difference(left[left_cuts[k] : left_cuts[k + 1]], right[right_cuts[k] : right_cuts[k + 1]]) <= most[k]
            ]
            if keep:
                yield batch.select(["a", "b"]).take(pa.array(keep))

    return run


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all rows, with the row above the element's bits, and how many each row has."""
    data, cuts = raw(packed)
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = data.reshape(-1, 6)
    sizes = np.diff(cuts) // 6
    return wide.reshape(-1).view(np.uint64) | (np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64) << np.uint64(48)), sizes


def _linked(percent: int):
    """Rows (a, b, left, right) to the pairs (a, b) whose sets link, compared whole."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "left", COMPARED):
                left, left_sizes = _unpacked(part.column("left"))
                right, right_sizes = _unpacked(part.column("right"))
                both = np.sort(np.concatenate([left, right]))
                shared = both[1:][both[1:] == both[:-1]] >> np.uint64(48)
                common = np.bincount(shared.astype(np.int64), minlength=part.num_rows)
                keep = np.flatnonzero(100 * common >= percent * (left_sizes + right_sizes - common))
                if len(keep):
                    yield part.select(["a", "b"]).take(pa.array(keep))

    return run


def _node(member: str):
    return F.col(member).bitwiseAND(F.lit(NODE))


def link(df: DataFrame, doc: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that a row reaches by links) of every row."""
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    kind = dict(docs.dtypes)["doc"]
    names = ["doc", "n", "node", "other", "cell", "rows"]
    first = write_scratch(docs.mapInArrow(tidy(_first_pass(width, names)), f"doc {kind}, n long, node long, other long, cell long, rows long"), "sets")
    heads, counts = first.where("n IS NOT NULL"), np.zeros(CELLS, np.int64)
    cells = first.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("rows").alias("rows")).toArrow()  # CELLS rows at most
    counts[cells.column("cell").to_numpy()] = cells.column("rows").to_numpy()

    rows = docs.mapInArrow(tidy(_signature_pass(width, percent, spark.sparkContext.broadcast(counts), crowded)), "bucket long, sig long, member long")
    sorted_rows = rows.repartition("bucket").sortWithinPartitions("bucket", "member")
    stars = write_scratch(sorted_rows.mapInArrow(tidy(_stars), "sig long, pivot long, member long, salted boolean"), "stars")
    del rows, sorted_rows
    release(spark)
    whole, split_up = stars.where("NOT salted"), stars.where("salted")
    tops = split_up.groupBy("sig").agg(F.min("pivot").alias("top")).where(F.col("top") < BEYOND)
    split_up = split_up.join(tops, "sig")
    over = split_up.select("sig", F.col("top").alias("pivot"), F.col("pivot").alias("member"), "salted").distinct()
    stars = whole.unionAll(split_up.drop("top")).unionAll(over).where(_node("pivot") != _node("member"))

    candidates = stars.select(F.explode(F.array(_node("pivot"), _node("member"))).alias("node"))
    known = spark.sparkContext.broadcast(filter_of(candidates))
    sets = write_scratch(docs.mapInArrow(tidy(_set_pass(width, known)), "node long, elements binary").dropDuplicates(["node"]), "elements")

    cells = write_scratch(sets.mapInArrow(tidy(_histogram_pass), "node long, size long, cells binary"), "histograms")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (pivot, member) that link, as edges of nodes. Histograms rule out most of the others exactly; sets are
        shuffled only for the pairs that are left."""
        nodes = pairs.select(F.least(_node("pivot"), _node("member")).alias("a"), F.greatest(_node("pivot"), _node("member")).alias("b")).distinct()
        one = cells.select(F.col("node").alias("a"), F.col("size").alias("left_size"), F.col("cells").alias("left"))
        two = cells.select(F.col("node").alias("b"), F.col("size").alias("right_size"), F.col("cells").alias("right"))
        fits = F.least("left_size", "right_size") * 100 >= F.greatest("left_size", "right_size") * percent
        left_over = nodes.join(one, "a").join(two, "b").where(fits).mapInArrow(tidy(_possible(percent)), "a long, b long")
        left_over = write_scratch(left_over, "pairs")
        # The sets of many pairs are shuffled in parts, and each part's shuffles go before the next one's come.
        parts, out = PARTS if left_over.count() > ONE_PART else 1, None
        for k in range(parts):
            own = left_over.where(F.pmod(F.xxhash64("a"), F.lit(parts)) == k)
            asked = spark.sparkContext.broadcast(filter_of(own.select(F.explode(F.array("a", "b")).alias("node"))))
            needed = sets.mapInArrow(tidy(_sifted(asked)), "node long, elements binary")
            left = needed.select(F.col("node").alias("a"), F.col("elements").alias("left"))
            right = needed.select(F.col("node").alias("b"), F.col("elements").alias("right"))
            links = write_scratch(own.join(left, "a").join(right, "b").mapInArrow(tidy(_linked(percent)), "a long, b long"), "links")
            out = links if out is None else out.unionAll(links)
            del own, needed, left, right
            release(spark)
            asked.destroy()
        return out

    release(spark)

    def of_node(rows: DataFrame, member: str, name: str) -> DataFrame:
        own = found.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        return rows.join(own, _node(member) == F.col("_node"), "left").withColumn(name, F.coalesce("_component", _node(member))).drop("_node", "_component")

    # One pair for each member first, which joins most groups of near copies; then the pairs that are still apart.
    meeting = stars.where(F.col("pivot") < BEYOND).select(_node("pivot").alias("pivot"), _node("member").alias("member")).distinct()
    nearest = write_scratch(meeting.groupBy("member").agg(F.min("pivot").alias("pivot")), "nearest")
    edges = verified(nearest)
    found = components(edges)
    rest = of_node(of_node(meeting.join(nearest, ["pivot", "member"], "left_anti"), "pivot", "ours"), "member", "theirs").where("ours <> theirs")
    more = verified(rest)
    if not more.isEmpty():
        edges = edges.unionAll(more)
        found = components(edges)

    apart = of_node(of_node(stars, "pivot", "ours"), "member", "theirs").where("ours <> theirs").select("sig").distinct()
    open_ = stars.join(apart, "sig", "left_semi")
    members = open_.select("sig", "salted", F.explode(F.array("pivot", "member")).alias("member")).groupBy("sig", "member").agg(F.max("salted").alias("salted"))
    # Texts with a passage in common meet in all its shingles: of buckets with the same members one is enough.
    alike = F.struct(F.count("*"), F.bit_xor(F.xxhash64("member")), F.bit_xor(F.xxhash64("member", F.lit(1))), F.max("salted")).alias("alike")
    kept = members.groupBy("sig").agg(alike).groupBy("alike").agg(F.min("sig").alias("sig")).select("sig")
    members = members.join(kept, "sig", "left_semi")
    ranked = write_scratch(members.withColumn("rank", F.row_number().over(Window.partitionBy("sig").orderBy("member"))), "open")
    # The first of a salted bucket has met the first ones of its parts only, so it has its turn in the first round.
    turn = F.col("rank") + F.col("salted").cast("int")
    rows, last = ranked.count(), ranked.where(F.col("member") < BEYOND).agg(F.max(turn).alias("turn")).first().turn or 0
    low, high = 1, 2
    while low < last:
        now = of_node(ranked, "member", "component")
        own = now.groupBy("sig", "component").agg(F.count("*").cast("double").alias("n")).groupBy("sig")
        left = own.agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("pairs")).agg(F.sum("pairs") / 2).first()[0]
        if not left:
            break
        if left <= max(ROW_PAIRS * rows, ROUND_PAIRS):
            high = last
        pivots = now.where((F.col("member") < BEYOND) & (F.col("rank") <= high) & ((F.col("rank") > low) | (F.col("salted") & (F.lit(low) == 1))))
        pivots = pivots.select("sig", F.col("member").alias("pivot"), F.col("rank").alias("place"), F.col("component").alias("ours"))
        pairs = pivots.join(now, "sig").where((F.col("rank") > F.col("place")) & (F.col("ours") != F.col("component")))
        more = verified(pairs.where(_node("pivot") != _node("member")))
        if not more.isEmpty():
            edges = edges.unionAll(more)
            found = components(edges)
        low, high = high, 2 * high

    same = F.when(F.min("other") != F.max("other"), F.raise_error(F.lit("two sets have one 61-bit name"))).otherwise(F.min("doc"))
    least = heads.where("n > 0").groupBy("node").agg(same.alias("least"))
    placed = least.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "component").select(F.col("node").alias("_node"), "component_id")
    joined = heads.join(named, (F.col("node") == F.col("_node")) & (F.col("n") > 0), "left")
    return joined.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))
