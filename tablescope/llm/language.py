"""Language ID with language-bitmask n-gram filters.

Training counts the character n-grams of all texts with a language, in Spark. An n-gram belongs to every language in which
its share is at least MIN_SHARE, and at least MIN_RATIO of its largest share in any language. Each language's n-grams go
into a Bloom filter; the filters are bit-sliced: one array of slots, in each slot one bit per language, so that the slots
of an n-gram, and-ed, say at once which languages (may) contain it. A text is decided by the bits counted per language over
all its n-grams, corrected for the share that each filter lets through by chance.

Letters are Unicode letters, lower-cased one by one; whatever lies between them is one gap, and a gap stands at both ends.
Texts that are null or without letter are `und` with score 0; so is every text if nothing could be learned. Equal evidence
goes to the first language in sorted order; without evidence the language with most n-grams is taken. Training rows with null
language, null text or no letter teach nothing. Rows are judged one by one: repeated rows alike, empty tables stay empty.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.frames import tidy
from tablescope.llm.words import mixed, slices

ORDERS = (3, 4)
#: Share of a language's n-grams that an n-gram needs; so a language has at most 1 / MIN_SHARE n-grams of an order.
MIN_SHARE = 1e-5
MIN_RATIO = 0.02
SLOTS, HASHES = 1 << 21, 3
#: Text expanded into n-grams at once.
PART_BYTES = 1 << 19
#: Numbers that are counted anew in a table, also for short texts.
TABLE = 1 << 19
#: Languages in one word of a slot.
WORD = 62
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point the lower-cased letter, 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        if unicodedata.category(c := chr(code))[0] == "L":
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def densified(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below `size` counted anew from 0 on in the same order, and a place of each that occurs."""
    if size > max(TABLE, 2 * len(numbers)):
        _, place, again = np.unique(numbers, return_index=True, return_inverse=True)
        return again, place
    place = np.full(size, -1, np.int32)
    place[numbers] = np.arange(len(numbers), dtype=np.int32)
    found = np.flatnonzero(place >= 0)
    first = place[found]
    place[found] = np.arange(len(found), dtype=np.int32)
    return place[numbers].astype(np.int64), first


def coded_grams(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the hashes of the different n-grams, and for each n-gram in the texts which of these it is and its
    row, in order; and which rows have a letter. Only different n-grams are hashed."""
    parts = [x or "" for x in texts.to_pylist()]
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    # A gap in front of each text, and one behind the last.
    place = np.cumsum(sizes + 1) - sizes - 1
    code = np.zeros(len(points) + len(parts) + 1, np.uint32)
    filled = np.ones(len(code), dtype=bool)
    filled[place] = filled[-1] = False
    code[filled] = letters()[points]
    row = np.append(np.repeat(np.arange(len(parts)), sizes + 1), len(parts))
    gap = code == 0
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    code, row = code[keep], row[keep]
    spoken = np.bincount(row[code > 0], minlength=len(parts) + 1)[: len(parts)] > 0
    known = np.zeros(0x110000, dtype=bool)
    known[code] = True
    alphabet = np.flatnonzero(known)
    number = np.zeros(0x110000, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    letter = number[code]
    found, now, have = [], letter, len(alphabet)
    for order in range(2, max(ORDERS) + 1):
        n = len(code) - order + 1
        if n <= 0:
            break
        now, first = densified(now[:n] * len(alphabet) + letter[order - 1 :], have * len(alphabet))
        have = len(first)
        if order not in ORDERS:
            continue
        value = np.full(have, order, np.uint64)
        for k in range(order):
            value = mixed((value << np.uint64(1)) ^ (code[first + k].astype(np.uint64) + (value << np.uint64(22))))
        # A gap may only be first or last; the gap that opens the next text closes this one. Letters decide the row.
        whole = np.ones(n, dtype=bool)
        for k in range(1, order - 1):
            whole &= code[k : k + n] > 0
        found.append((value, now[whole], row[1 : n + 1][whole]))
    return found, spoken


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams with the row of each, and which rows have a letter."""
    found, spoken = coded_grams(texts)
    hashes, rows = [value[which] for value, which, _ in found], [row for _, _, row in found]
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), (np.concatenate(rows) if rows else np.zeros(0, np.int64)), spoken


def gram_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(gram, lang, n): how often each n-gram stands in texts of each language; counted per slice before the shuffle."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, PART_BYTES):
                found, _ = coded_grams(part.column(text))
                coded = part.column(lang).dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False)
                for hashes, which, rows in found:
                    own = code[rows]
                    for k, name in enumerate(coded.dictionary.to_pylist()):
                        counts = np.bincount(which[own == k], minlength=len(hashes))
                        some = np.flatnonzero(counts)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(hashes[some].view(np.int64)), pa.array([name] * len(some), pa.string()), pa.array(counts[some])], names=["gram", "lang", "n"]
                        )

    counted = df.select(text, lang).mapInArrow(tidy(run), "gram long, lang string, n long")
    return counted.groupBy("gram", "lang").agg(F.sum("n").alias("n"))


@dataclass
class Filters:
    """Bit-sliced Bloom filters: languages, slots (one row per word of bits), chance hits and n-gram totals per language."""

    languages: list[str]
    slots: np.ndarray
    chance: np.ndarray
    totals: np.ndarray

    def containing(self, hashes: np.ndarray) -> np.ndarray:
        """Bits of the languages that contain each n-gram, one row per word of bits."""
        bits = None
        for place in slot_of(hashes):
            here = self.slots[:, place]
            bits = here if bits is None else bits & here
        return bits

    def hits(self, hashes: np.ndarray, which: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How many n-grams of each row each language contains; `counts` of `which` belong to each row, in order.

        Languages are counted side by side in the bits of one number, as many as fit at the longest row's count.
        """
        out = np.zeros((len(counts), len(self.languages)))
        filled = np.flatnonzero(counts)
        if not len(filled):
            return out
        bits = self.containing(hashes).view(np.uint64)
        begin = (np.cumsum(counts) - counts)[filled]
        width = int(counts.max()).bit_length()
        mask = np.uint64((1 << width) - 1)
        for low in range(0, len(self.languages), 64 // width):
            own = range(low, min(low + 64 // width, len(self.languages)))
            packed = np.zeros(len(hashes), np.uint64)
            for lane, k in enumerate(own):
                packed |= (bits[k // WORD] >> np.uint64(k % WORD) & np.uint64(1)) << np.uint64(lane * width)
            sums = np.add.reduceat(packed[which], begin)
            for lane, k in enumerate(own):
                out[filled, k] = sums >> np.uint64(lane * width) & mask
        return out

    def decide(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        found, spoken = coded_grams(texts)
        n = len(spoken)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        counts = [np.bincount(rows, minlength=n) for _, _, rows in found]
        total = sum(counts, np.zeros(n))
        hits = sum((self.hits(hashes, which, own) for (hashes, which, _), own in zip(found, counts, strict=True)), np.zeros((n, len(self.languages))))
        share = np.zeros((n, len(self.languages)))
        for k in range(len(self.languages)):
            share[:, k] = (hits[:, k] - total * self.chance[k]) / (np.maximum(total, 1) * (1 - self.chance[k]))
        share = np.clip(np.round(share, 9), 0, 1)
        best = np.where(share.max(axis=1) > 0, share.argmax(axis=1), int(self.totals.argmax()))
        score = np.where(spoken, share[np.arange(n), best], 0.0)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), spoken.tolist(), strict=True)], score


def slot_of(hashes: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield (mixed(hashes + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) & np.uint64(SLOTS - 1)).astype(np.int64)


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> Filters:
    """Filters of all rows with a language. What reaches the driver is bounded by SLOTS and the number of languages."""
    from tablescope.plans.scratch import write_scratch

    counts = write_scratch(gram_counts(df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()), text, lang), "grams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Filters([], np.zeros((1, SLOTS), np.int64), np.zeros(0), np.zeros(0))
    known = df.sparkSession.createDataFrame([(name, i, float(totals[name])) for i, name in enumerate(languages)], "lang string, bit int, total double")
    shares = counts.join(F.broadcast(known), "lang").withColumn("share", F.col("n") / F.col("total"))
    top = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("bit", "share")).alias("found"))
    belongs = F.filter("found", lambda x: (x["share"] >= MIN_SHARE) & (x["share"] >= MIN_RATIO * F.col("top")))
    member = top.select("gram", F.explode(belongs).alias("x")).select("gram", "x.bit")
    masks = member.groupBy("gram", F.floor(F.col("bit") / WORD).cast("int").alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, bit % {WORD}))").alias("mask")
    )

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("gram").to_numpy(zero_copy_only=False).view(np.uint64)
            for place in slot_of(hashes):
                yield pa.RecordBatch.from_arrays([pa.array(place), batch.column("word"), batch.column("mask")], names=["slot", "word", "mask"])

    filled = masks.mapInArrow(run, "slot long, word int, mask long").groupBy("word", "slot").agg(F.expr("bit_or(mask)").alias("mask"))
    slots = np.zeros(((len(languages) - 1) // WORD + 1, SLOTS), np.int64)
    found = filled.toArrow()
    slots[found.column("word").to_numpy(), found.column("slot").to_numpy()] = found.column("mask").to_numpy()
    fill = np.array([np.count_nonzero(slots[k // WORD] >> (k % WORD) & 1) / SLOTS for k in range(len(languages))])
    return Filters(languages, slots, fill**HASHES, np.array([totals[x] for x in languages], np.float64))


def predict(df: DataFrame, filters: Filters, text: str = "text", predicted: str = "lang_pred", score: str = "score", keep_text: bool = True) -> DataFrame:
    """All columns of `df`, the predicted language and the share of n-grams that it explains."""
    if clash := {c.lower() for c in df.columns} & {predicted.lower(), score.lower()}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(predicted, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(filters)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, PART_BYTES):
                languages, scores = shared.value.decide(part.column(text))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(languages, pa.string()), pa.array(scores)], names=schema.names)

    return df.mapInArrow(tidy(run), schema)


def held_out(doc: str = "doc_id"):
    """Rows that no query learns from: crc32 of the id's text is 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc).cast("string")), F.lit(4)) == 2, F.lit(False))
