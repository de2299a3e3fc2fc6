"""SentencePiece encoding and decoding of whole text columns by vectorised merge rounds.

The vocabulary file (BPE with byte fallback, identity normaliser) is read here; the sentencepiece library is not used.
Texts are cut at places that no piece spans, each distinct part of a slice is merged once, and all parts of a slice are
merged together: a flat array holds their symbols, each round finds the smallest pair rank of every part, merges its
occurrences from the left at once, and drops parts that have no pair left. Where a merge could bring up a pair of equal or
smaller rank (such pieces are found when the file is read) only the leftmost occurrence is merged in that round.

Null and empty texts have no ids and decode to the empty text. Rows are independent: repeated rows, ties and extra
columns change nothing, an empty table gives an empty table. A column named like an output column is refused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablescope.llm.frames import tidy
from tablescope.llm.words import raw, slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
#: Bytes of distinct parts, with what a dictionary takes for each, that one Python worker keeps between slices; bytes of a slice.
KEPT_BYTES, PART_BYTES, SLICE_BYTES = 16 << 20, 160, 1 << 18


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 2: None, 5: 4}[tag & 7]
            size = number() if size is None else size
            yield tag >> 3, data[at : at + size]
            at += size


class Vocabulary:
    """Pieces of a model file, the pairs that merge, and what each id decodes to."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            parts = list(_fields(file.read()))
        settings = dict(_fields(next((v for k, v in parts if k == 3), b"")))
        if settings.get(2) or settings.get(4, 1) or not settings.get(3, 1) or not settings.get(5, 1):
            raise ValueError("only an identity normaliser with a leading space, keeping all white space, is supported")
        pieces = []
        for _, piece in (x for x in parts if x[0] == 1):
            own = dict(_fields(piece))
            pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        if any(kind not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, kind in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.size = len(pieces)
        normal = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        scores = np.array([s for _, s, _ in pieces], np.float32)
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)

        #: The symbol of each character: its piece, or else a number beyond the pieces.
        self.symbol = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.bytes = np.zeros(256, np.int32)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(p[1:-1], 16)] = i
        if len({p for p, _, kind in pieces if kind == BYTE}) != 256:
            raise ValueError("the file has no byte fallback")

        def symbol(part: str) -> int | None:
            return int(self.symbol[ord(part)]) if len(part) == 1 else normal.get(part)

        pairs, risky, inner = {}, np.zeros(self.size, dtype=bool), set()
        for p, i in normal.items():
            inner.update(zip(p, p[1:], strict=False))
            for k in range(1, len(p)):
                left, right = symbol(p[:k]), symbol(p[k:])
                if left is None or right is None:
                    continue
                pairs[left << 21 | right] = i
                for part in (left, right):
                    if part < self.size and rank[part] >= rank[i]:
                        risky[part] = True
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.rank, self.risky = rank, risky
        #: Neighbouring characters inside some piece; no merge spans other neighbours.
        self.inner = np.array(sorted(ord(a) << 21 | ord(b) for a, b in inner), np.int64)

        shown = [p.replace(SPACE, " ").encode() if kind == NORMAL else bytes([int(p[1:-1], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else b"" for p, _, kind in pieces]
        self.shown = pa.array(shown, pa.binary())
        self.is_byte = np.array([kind == BYTE for _, _, kind in pieces])
        self.leads = np.array([kind == NORMAL and p.startswith(SPACE) for p, _, kind in pieces])
        self.hidden = np.array([kind == CONTROL for _, _, kind in pieces])
        self.decimal = pa.array([str(i) for i in range(self.size)])

    def found(self, keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
        return at, among[at] == keys

    def merge(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, given the code points of all parts and the length of each; and how many ids each has."""
        symbols = self.symbol[points].astype(np.int64)
        part = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(symbols))
        result, done = np.full(len(symbols), -1, np.int64), np.iinfo(np.int32).max
        # A group is what merges can reach: cut between parts and between neighbours that no piece holds.
        starts = np.ones(len(symbols), dtype=bool)
        starts[1:] = part[1:] != part[:-1]
        if len(symbols) > 1:
            starts[1:] |= ~self.found(points[:-1].astype(np.int64) << 21 | points[1:], self.inner)[1]
        group = np.cumsum(starts) - 1
        where = place
        while len(symbols) > 1:
            at, hit = self.found(symbols[:-1] << 21 | symbols[1:], self.keys)
            hit &= group[1:] == group[:-1]
            target = self.merged[at]
            rank = np.append(np.where(hit, self.rank[target], done), done)
            first = np.flatnonzero(np.diff(group, prepend=-1))
            sizes_now = np.diff(np.append(first, len(group)))
            low = np.minimum.reduceat(rank, first)
            low_each = np.repeat(low, sizes_now)
            live = low_each < done
            if not live.all():
                over = ~live
                result[where[over]] = symbols[over]
                symbols, group, where, rank, low_each = symbols[live], group[live], where[live], rank[live], low_each[live]
                if not len(symbols):
                    break
                target = np.append(target, 0)[live]
            else:
                target = np.append(target, 0)
            chosen = rank == low_each
            # Of overlapping occurrences every second one, from the left, is merged.
            run = chosen.copy()
            run[1:] &= ~chosen[:-1]
            run_start = np.maximum.accumulate(np.where(run, np.arange(len(run)), 0))
            chosen &= (np.arange(len(chosen)) - run_start) % 2 == 0
            hits = np.flatnonzero(chosen)
            # A risky piece is merged at its first place only.
            own = group[hits]
            again = np.zeros(len(hits), dtype=bool)
            again[1:] = own[1:] == own[:-1]
            if again.any():
                careful = self.risky[target[hits]]
                if careful.any():
                    bad = np.zeros(int(group[-1]) + 1, dtype=bool)
                    bad[own[careful]] = True
                    hits = hits[~(again & bad[own])]
            symbols[hits] = target[hits]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hits + 1] = False
            symbols, group, where = symbols[keep], group[keep], where[keep]
        result[where] = symbols
        ids = result[result >= 0]
        of = part[result >= 0]
        unknown = ids >= self.size
        if unknown.any():
            code = ids - self.size
            width = np.where(unknown, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1)
            text = "".join(map(chr, code[unknown].tolist())).encode()
            fallback = np.repeat(unknown, width)
            ids, of = np.repeat(ids, width), np.repeat(of, width)
            ids[fallback] = self.bytes[np.frombuffer(text, np.uint8)]
        return ids.astype(np.int32), np.bincount(of, minlength=len(sizes))

    def decode_parts(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each row of ids, as the library's decode(ids)."""
        lead = np.zeros(len(ids), dtype=bool)
        visible = ~self.hidden[ids]
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        shown = np.flatnonzero(visible)
        first = shown[np.diff(rows[shown], prepend=-1) > 0] if len(shown) else shown
        lead[first] = self.leads[ids[first]]
        values = self.shown.take(pa.array(ids))
        flat, cuts = raw(values)
        keep = np.ones(len(flat), dtype=bool)
        keep[cuts[:-1][lead]] = False
        text = flat[keep].tobytes()
        ends = cuts[offsets] - np.concatenate([[0], np.cumsum(lead)])[offsets]
        out = []
        for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            try:
                out.append(text[a:b].decode())
            except UnicodeDecodeError:
                out.append(self._repaired(ids[offsets[row] : offsets[row + 1]]))
        return out

    def _repaired(self, ids: np.ndarray) -> str:
        """A row whose byte ids are no whole characters: each byte that fits nowhere becomes U+FFFD."""
        out, shown, start = [], self.shown.take(pa.array(ids)).to_pylist(), True
        at = 0
        while at < len(ids):
            if not self.is_byte[ids[at]]:
                piece = shown[at].decode()
                if not self.hidden[ids[at]]:
                    piece = piece[1:] if start and self.leads[ids[at]] else piece
                    start = False
                out.append(piece)
                at += 1
                continue
            end = at
            while end < len(ids) and self.is_byte[ids[end]]:
                end += 1
            run, start = b"".join(shown[at:end]), False
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                run = run[n:]
            at = end
        return "".join(out)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes slices of texts; keeps the ids of parts it has seen, up to a bound."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.counts = [], []
        self.kept = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the offsets of each row."""
        data, offsets = raw(pc.replace_substring(texts.fill_null("").cast(pa.large_string()), SPACE, " "))
        lengths = np.diff(offsets)
        full = lengths > 0
        # A leading space for each text that is not empty.
        data = np.insert(data, offsets[:-1][full], 0x20)
        offsets = np.concatenate([[0], np.cumsum(lengths + full)])
        space = data == 0x20
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[offsets[:-1][full]] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(data))
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        found = parts.dictionary_encode()
        codes, distinct = found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()
        if self.kept > KEPT_BYTES:
            self.clear()
        known = self.known
        fresh = [x for x in distinct if x not in known]
        if fresh:
            texts_new = [x.decode() for x in fresh]
            points = np.frombuffer("".join(texts_new).encode("utf-32-le"), np.uint32)
            points = np.where(points == 0x20, ord(SPACE), points)
            ids, counts = self.vocab.merge(points, np.fromiter(map(len, texts_new), np.int64, len(fresh)))
            first = len(known)
            known.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            self.kept += sum(map(len, fresh)) + PART_BYTES * len(fresh)
            self.ids.append(ids)
            self.counts.append(counts)
        if len(self.ids) > 1:
            self.ids, self.counts = [np.concatenate(self.ids)], [np.concatenate(self.counts)]
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        which = np.fromiter((known[x] for x in distinct), np.int64, len(distinct))[codes]
        all_ids, counts = self.ids[0], self.counts[0]
        begin = (np.cumsum(counts) - counts)[which]
        sizes = counts[which]
        ends = np.cumsum(sizes)
        spread = np.arange(ends[-1]) + np.repeat(begin - (ends - sizes), sizes)
        row_cuts = np.searchsorted(starts, offsets)
        return all_ids[spread], np.concatenate([[0], ends])[row_cuts]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns, and `ids`: the ids of the whole text, without begin or end ids."""
    return _per_slice(df, text, [T.StructField(ids, T.ArrayType(T.IntegerType(), False))], _encoded, path)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns, and `text`: what the ids decode to; null or no ids give the empty text."""
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])
    _refuse(df, [text])

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            rows = batch.column(ids)
            step = max(1, 2_000_000 // max(1, int(len(rows.flatten()) / max(1, len(rows)))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = part.column(ids)
                counts = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
                flat = found.flatten().to_numpy(zero_copy_only=False)
                texts = vocab.decode_parts(flat, np.concatenate([[0], np.cumsum(counts)]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(tidy(run), schema)


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns but the text, and n_tokens, ids_sha256 and decoded_sha256 of each row's ids and decoded text.

    Same encoder and decoder as above; the digests are taken in the task, so neither ids nor decoded texts leave it.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _per_slice(df, text, fields, _digested, path, keep_text=False)


def _refuse(df: DataFrame, names: list[str]) -> None:
    if clash := sorted({c.lower() for c in df.columns} & {n.lower() for n in names}):
        raise ValueError(f"columns {clash} are there already")


def _encoded(vocab: Vocabulary, ids: np.ndarray, cuts: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))]


def _digested(vocab: Vocabulary, ids: np.ndarray, cuts: np.ndarray) -> list[pa.Array]:
    from hashlib import sha256

    numbers = pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), vocab.decimal.take(pa.array(ids)).cast(pa.large_string()))
    joined = pc.binary_join(numbers, pa.scalar(",", pa.large_string()))
    texts = vocab.decode_parts(ids, cuts)
    return [
        pa.array(np.diff(cuts), pa.int64()),
        pa.array([sha256(x.encode()).hexdigest() for x in joined.to_pylist()]),
        pa.array([sha256(x.encode()).hexdigest() for x in texts]),
    ]


def _per_slice(df: DataFrame, text: str, fields: list[T.StructField], made, path: str, keep_text: bool = True) -> DataFrame:
    _refuse(df, [f.name for f in fields])
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*kept, *fields])
    names = [f.name for f in kept]

    def run(batches):
        encoder = Encoder(vocabulary(path))
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                columns = made(encoder.vocab, *encoder.encode(part.column(text)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns], names=schema.names)

    return df.mapInArrow(tidy(run), schema)
