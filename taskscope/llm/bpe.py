"""Byte-level BPE: encode whole texts to ids, decode ids, keep every token's place.

Splitting into slices before the merges needs no regular expression: every code
point gets a class that holds what the pattern looks ahead for, and a finite
automaton over these classes says where slices start.  Its transition functions
form a small monoid, so all states come from an associative scan: the functions
of short columns are composed side by side, then column by column.  Equal slices
of a piece are merged once, and merges are cached between pieces.

Ids are those of the rank file's usual library for its usual pattern:
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Nulls count as empty texts, which have no tokens.  Rows are independent: repeated
rows give repeated results, other columns are passed on or left out untouched, and
an empty table gives an empty result.  Memory holds one piece of 2 MiB, or one text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from taskscope.llm.words import _BYTE, _power, mixed, pieces, utf8

# symbols: classes of code points with what follows them in the same text
LETTER, DIGIT, OTHER, QUOTE2, QUOTE3, LEAD, LAST, BLANK = range(8)
SYMBOLS = 8
# states: what the slice that holds the code point before is
CLOSED, IN_LETTERS, IN_DIGITS, IN_OTHERS, AFTER_LEAD, IN_BLANKS, ONE_MORE, TWO_MORE = range(8)
STATES = 8

#: Code points with the property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
         0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Slices up to so many bytes are cached, so many of them.
CACHED_BYTES, CACHED = 64, 400_000
COLUMN = 128
NONE = 1 << 60


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a code point, and whether a slice starts at it."""
    joined = state == AFTER_LEAD
    if symbol == LETTER:
        if state in (ONE_MORE, TWO_MORE):
            return (CLOSED if state == ONE_MORE else ONE_MORE), False
        return IN_LETTERS, not (joined or state == IN_LETTERS)
    if symbol == DIGIT:
        return IN_DIGITS, not (joined or state == IN_DIGITS)
    if symbol == OTHER or joined or state == IN_OTHERS and symbol in (QUOTE2, QUOTE3):
        return IN_OTHERS, not (joined or state == IN_OTHERS)
    if symbol in (QUOTE2, QUOTE3):
        return (ONE_MORE if symbol == QUOTE2 else TWO_MORE), True
    if symbol == BLANK:
        return IN_BLANKS, state != IN_BLANKS
    return (AFTER_LEAD if symbol == LEAD else CLOSED), True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the transition functions: generators, product table, results from CLOSED.

    Symbols from SYMBOLS on are first code points of texts: constant functions.
    """
    gens = []
    for symbol in range(2 * SYMBOLS):
        first = symbol >= SYMBOLS
        gens.append(tuple(_step(CLOSED if first else s, symbol % SYMBOLS)[0] for s in range(STATES)))
    found = {tuple(range(STATES)): 0}
    todo = list(found)
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    elements = sorted(found, key=found.get)
    table = np.empty((len(elements), len(elements)), np.int16)
    for f, i in found.items():
        for g, j in found.items():
            table[i, j] = found[tuple(g[x] for x in f)]
    return (np.array([found[g] for g in gens], np.int16), table,
            np.array([f[CLOSED] for f in elements], np.int8))


GENERATORS, PRODUCT, FROM_CLOSED = _monoid()
STARTS = np.array([[_step(s, x)[1] for x in range(SYMBOLS)] for s in range(STATES)])


WIDTH = 1 << (len(PRODUCT) - 1).bit_length()
_FLAT = np.zeros((WIDTH, WIDTH), np.uint8)
_FLAT[:len(PRODUCT), :len(PRODUCT)] = PRODUCT
_FLAT = _FLAT.ravel()
_SHIFT = np.uint16(WIDTH.bit_length() - 1)


def _then(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    return _FLAT.take((f.astype(np.uint16) << _SHIFT) | g)


def scan(symbols: np.ndarray) -> np.ndarray:
    """Composition of all functions up to each position, by an associative scan."""
    n = len(symbols)
    rows = -(-n // COLUMN)
    padded = np.zeros(rows * COLUMN, np.uint8)  # 0 is the identity
    padded[:n] = GENERATORS.astype(np.uint8)[symbols]
    grid = np.ascontiguousarray(padded.reshape(rows, COLUMN).T)
    for j in range(1, COLUMN):
        grid[j] = _then(grid[j - 1], grid[j])
    carry = grid[-1].copy()  # inclusive scan over the rows' totals by doubling
    step = 1
    while step < rows:
        carry[step:] = _then(carry[:-step], carry[step:])
        step *= 2
    before = np.concatenate([np.zeros(1, np.uint8), carry[:-1]])
    for j in range(COLUMN):
        grid[j] = _then(before, grid[j])
    return grid.T.reshape(-1)[:n]


_classes: list[np.ndarray] = []


def _code_point_classes() -> np.ndarray:
    if not _classes:
        table = np.full(0x110000, OTHER, np.uint8)
        for cp in range(0x110000):
            kind = unicodedata.category(chr(cp))[0]
            if kind == "L":
                table[cp] = LETTER
            elif kind == "N":
                table[cp] = DIGIT
        table[WHITE] = BLANK
        _classes.append(table)
    return _classes[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and where each starts."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    out = lead.copy()
    size = np.diff(np.append(at, len(data)))
    for k, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        many = np.flatnonzero(size == k)
        if len(many):
            value = lead[many] & mask
            for j in range(1, k):
                value = (value << np.uint32(6)) | (data[at[many] + j] & np.uint8(0x3F))
            out[many] = value
    return np.minimum(out, 0x10FFFF), at


def slice_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where slices start, and where code points start."""
    cps, at = code_points(data)
    n = len(cps)
    if not n:
        return at, at
    kind = _code_point_classes()[cps]
    is_first = np.zeros(len(data) + 1, bool)
    is_first[offsets] = True
    first = is_first[at]
    is_last = np.append(first[1:], True)

    symbols = kind.copy()
    blank = kind == BLANK
    ends = blank.copy()
    ends[:-1] &= ~blank[1:]
    ends &= ~is_last
    symbols[ends] = LAST
    symbols[ends & (cps == 0x20)] = LEAD
    quotes = np.flatnonzero((cps == 0x27) & ~is_last)
    if len(quotes):
        one = cps[quotes + 1]
        more = ~is_last[quotes + 1]
        two = np.where(more, cps[np.minimum(quotes + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) \
            | (one == ord("l")) & (two == ord("l"))
        symbols[quotes[short]] = QUOTE2
        symbols[quotes[long]] = QUOTE3
    reached = FROM_CLOSED[scan(symbols + first * np.uint8(SYMBOLS))]
    before = np.concatenate([[CLOSED], reached[:-1]])
    before[first] = CLOSED
    return at[STARTS[before, symbols]], at


@dataclass
class Tokens:
    """Ids of the texts of a piece in a row, byte ends of tokens, and each text's first token."""

    ids: np.ndarray
    ends: np.ndarray
    first: np.ndarray


class Codec:
    """Ranks of one file, with a bounded cache of merged slices."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.size = np.zeros(max(self.bytes) + 1, np.int64)
        for rank, token in self.bytes.items():
            self.size[rank] = len(token)
        self.begin = np.zeros(len(self.size), np.int64)
        order = sorted(self.bytes)
        self.begin[order] = np.cumsum(self.size[order]) - self.size[order]
        self.pool = np.frombuffer(b"".join(self.bytes[i] for i in order), np.uint8)
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Join the neighbours of lowest rank, the first of equals, until no pair has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        n = len(piece)
        if n <= CACHED_BYTES:
            return self._merge_short(piece)
        end = list(range(1, n + 1))  # of the part that starts here; 0: joined to an earlier one
        prev = list(range(-1, n - 1))
        heap = [(ranks[piece[i:i + 2]], i, i + 2) for i in range(n - 1) if piece[i:i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two has changed meanwhile
            end[i], end[j] = stop, 0
            if stop < n:
                prev[stop] = i
                r = ranks.get(piece[i:end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            p = prev[i]
            if p >= 0:
                r = ranks.get(piece[p:stop])
                if r is not None:
                    heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return tuple(out)

    def _merge_short(self, piece: bytes) -> tuple[int, ...]:
        rank = self.ranks.get
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pairs = [rank(piece[i:i + 2], NONE) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) != NONE:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], NONE)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], NONE)
        return tuple(map(self.ranks.__getitem__, parts))

    def slice_ids(self, piece: bytes) -> tuple[int, ...]:
        ids = self.cache.get(piece)
        if ids is None:
            ids = self.merge(piece)
            if len(piece) <= CACHED_BYTES:
                if len(self.cache) >= CACHED:
                    self.cache.clear()
                self.cache[piece] = ids
        return ids

    def encode(self, texts: pa.Array) -> Tokens:
        data, offsets = utf8(texts)
        start, _ = slice_starts(data, offsets)
        if not len(start):
            return Tokens(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
        end = np.append(start[1:], len(data))
        n = len(data)
        power, inverse = _power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
        key = mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        tokens = self._gather(data, start, end, one, which, offsets)
        if not np.array_equal(self.decode(tokens.ids), data):
            every = np.arange(len(start))  # two slices share a hash: merge each by itself
            tokens = self._gather(data, start, end, every, every, offsets)
        return tokens

    def _gather(self, data, start, end, one, which, offsets) -> Tokens:
        raw = data.tobytes()
        merged = [self.slice_ids(raw[s:e]) for s, e in zip(start[one].tolist(), end[one].tolist())]
        sizes = np.fromiter(map(len, merged), np.int64, len(merged))
        pool = np.fromiter((i for ids in merged for i in ids), np.int64, int(sizes.sum()))
        begins = np.cumsum(sizes) - sizes
        count = sizes[which]
        upto = np.cumsum(count)
        ids = pool[np.repeat(begins[which] - upto + count, count) + np.arange(upto[-1])]
        ends = np.cumsum(self.size[ids])
        return Tokens(ids, ends, np.searchsorted(ends, offsets, side="right")
                      if len(offsets) else np.zeros(0, np.int64))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for; an unknown id is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or not self.size[ids].all()):
            raise ValueError("an id is not in the rank file")
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.pool[np.repeat(self.begin[ids] - ends + size, size) + np.arange(ends[-1] if len(ids) else 0)]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each file and Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def char_ends(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Byte ends as numbers of code points begun before them."""
    return np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), ends)


def encode(docs: DataFrame, path: str, column: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, `ids`, and `ends`, the character after each token's last begun one.

    A token of part of a character ends where the character's first byte counts it.
    """
    name, kind = key, docs.schema[key].dataType
    schema = T.StructType([T.StructField(name, kind), T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("ends", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for piece in pieces(batches, column):
            texts = piece.column(1)
            data, offsets = utf8(texts)
            t = own.encode(texts)
            chars = char_ends(data, t.ends) - np.repeat(char_ends(data, offsets[:-1]), np.diff(t.first))
            lists = [pa.ListArray.from_arrays(pa.array(t.first, pa.int32()), pa.array(v, pa.int32()))
                     for v in (t.ids, chars)]
            yield pa.RecordBatch.from_arrays([piece.column(0), *lists], names=[name, "ids", "ends"])

    return docs.select(key, column).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """Per row: key and `bytes`, what the ids stand for; an unknown id is an error."""
    schema = T.StructType([encoded.schema[key], T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            out = [own.decode(np.array(ids or [], np.int64)).tobytes() for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[key, "bytes"])

    return encoded.select(key, column).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, column: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode each text and decode its ids: key, n_tokens, and SHA-256 of the ids (decimal,
    joined by commas) and of the decoded bytes, in lower-case hex."""
    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        names = {i: str(i) for i in own.bytes}
        for piece in pieces(batches, column):
            t = own.encode(piece.column(1))
            first = t.first.tolist()
            text = own.decode(t.ids)
            at = np.concatenate([[0], t.ends])[t.first].tolist()
            written = list(map(names.__getitem__, t.ids.tolist()))
            digests = [hashlib.sha256(",".join(written[a:b]).encode()).hexdigest()
                       for a, b in zip(first, first[1:])]
            decoded = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(np.diff(t.first), pa.int64()), pa.array(digests), pa.array(decoded)],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, column).mapInArrow(run, schema)
