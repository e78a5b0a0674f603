"""Benchmark passages in documents, by SimHash over windows of an item's own size.

Words are ASCII letters and digits and all characters beyond ASCII, lower-cased; a
shingle is five words in a row and weighs as many bytes as its words have.  For each
item's number of words, every window of that many words of a document that holds at
least one shingle of the benchmark gets a fingerprint of 64 bits (any other window
has similarity 0).  A shingle that repeats within a window or an item counts once, in
the fingerprints as in the similarity.  A document shorter than an item is one window
for it, whole.  Fingerprints are cut into four blocks of 16 bits; if two are
within `RADIUS` = 15 bits, one block differs in at most three, so an index of every
item's blocks with all changes of up to three bits finds all items within the
radius.  What is found is then measured exactly: weighted Jaccard of the shingles
of window and item, 0.8 or more.

Items of fewer than five words are one shingle each.  Null or empty items and
documents match nothing; repeated items and documents match one by one; ties of
similarity go to the earliest window; other columns are kept or ignored.  Items go
to the executors in blocks of about `BLOCK_WORDS` words, each block in a pass of its
own, so what is broadcast has a fixed bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from taskscope.llm.words import ALNUM, Words, mixed, pieces, words

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 15
BLOCKS, BLOCK_BITS = 4, 16
BLOCK_WORDS = 200_000
#: Windows fingerprinted at once.
AT_ONCE = 1 << 14

_FLIPS = np.array([sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1)
                   for c in combinations(range(BLOCK_BITS), k)], np.uint16)
_BITS = np.arange(64, dtype=np.uint64)


def _signs(h: np.ndarray) -> np.ndarray:
    return ((mixed(h)[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints: a bit for each positive sum."""
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def _weights(w: Words, at: np.ndarray, size: int) -> np.ndarray:
    """Bytes of the words of each shingle."""
    upto = np.concatenate([[0], np.cumsum(w.end - w.start)])
    return upto[at + size] - upto[at]


class Index:
    """Items with shingles of k words: fingerprints, block index, shingles with weights."""

    def __init__(self, k: int):
        self.k = k
        self.items: list[tuple[int, dict[int, int], int]] = []  # row of the item, shingles, weight
        self.words: list[int] = []

    def add(self, row: int, n: int, h: np.ndarray, weight: np.ndarray) -> None:
        counted = dict(zip(h.tolist(), weight.tolist()))
        self.items.append((row, counted, sum(counted.values())))
        self.words.append(n)

    def finish(self) -> None:
        prints = []
        for _, shingles, _ in self.items:
            h = np.array(list(shingles), np.uint64)
            prints.append(_packed((_signs(h) * np.array(list(shingles.values()))[:, None]).sum(axis=0)[None, :])[0])
        self.prints = np.array(prints, np.uint64)
        self.spans = np.array(self.words) - self.k + 1  # shingles of a window of the item's size
        self.span_list = np.unique(self.spans)
        self.lists = []
        for b in range(BLOCKS):
            block = (self.prints >> np.uint64(b * BLOCK_BITS)).astype(np.uint16)
            keys = (block[:, None] ^ _FLIPS[None, :]).ravel().astype(np.int64)
            order = np.argsort(keys, kind="stable")
            starts = np.searchsorted(keys[order], np.arange((1 << BLOCK_BITS) + 1))
            self.lists.append((starts, order // len(_FLIPS)))

    def near(self, prints: np.ndarray, spans: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All (fingerprint, item) pairs within the radius and of the same size; items of more
        than `most` shingles, if given, count as of that size."""
        sizes = self.spans if most is None else np.minimum(self.spans, most)
        rows, items = [], []
        for b, (starts, members) in enumerate(self.lists):
            block = (prints >> np.uint64(b * BLOCK_BITS)).astype(np.uint16).astype(np.int64)
            count = starts[block + 1] - starts[block]
            total = int(count.sum())
            if not total:
                continue
            ends = np.cumsum(count)
            rows.append(np.repeat(np.arange(len(prints)), count))
            items.append(members[np.repeat(starts[block] - ends + count, count) + np.arange(total)])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, item = np.concatenate(rows), np.concatenate(items)
        close = (spans[row] == sizes[item]) & (np.bitwise_count(prints[row] ^ self.prints[item]) <= RADIUS)
        pairs = np.unique(row[close] * len(self.items) + item[close])
        return pairs // len(self.items), pairs % len(self.items)


class Benchmark:
    """Items of one block, indexed by the number of words of their shingles."""

    def __init__(self, texts: list[str]):
        w = words(pc.utf8_lower(pa.array(texts, pa.string())), ALNUM, lower=False)
        self.index: dict[int, Index] = {}
        keys: dict[int, list[np.ndarray]] = {}
        for k in range(1, SHINGLE + 1):
            h, at = w.windows(k)
            cuts = np.searchsorted(at, w.first)
            for row in np.flatnonzero(w.counts >= SHINGLE if k == SHINGLE else w.counts == k).tolist():
                a, b = cuts[row], cuts[row + 1]
                self.index.setdefault(k, Index(k)).add(row, int(w.counts[row]), h[a:b], _weights(w, at[a:b], k))
                keys.setdefault(k, []).append(h[a:b])
        for index in self.index.values():
            index.finish()
        self.keys = {k: np.unique(np.concatenate(own)) for k, own in keys.items()}
        self.filter = {}
        for k, own in self.keys.items():
            table = np.zeros(1 << 20, bool)
            table[(own >> np.uint64(44)).astype(np.int64)] = True
            self.filter[k] = table

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int, int]]:
        """Row of the text, row of the item, similarity, Hamming distance, first word, words."""
        w = words(pc.utf8_lower(texts), ALNUM, lower=False)
        for k, own in self.keys.items():
            h, at = w.windows(k)
            hit = np.flatnonzero(self.filter[k][(h >> np.uint64(44)).astype(np.int64)])
            hit = hit[np.isin(h[hit], own)]
            if not len(hit) or len(w.start) < k:
                continue
            doc = np.searchsorted(w.first, at[hit], side="right") - 1
            whole = w.counts[np.searchsorted(w.first, at, side="right") - 1] >= k  # not a shorter text
            weights = np.where(whole, _weights(w, np.minimum(at, len(w.start) - k), k), 0)
            for d in np.unique(doc).tolist():
                if w.counts[d] >= k:
                    a, b = np.searchsorted(at, [w.first[d], w.first[d + 1]])
                    yield from self._in_text(d, k, h[a:b], weights[a:b], hit[doc == d] - a)

    def _in_text(self, d, k, h, weight, hits):
        n, index = len(h), self.index[k]
        best: dict[int, tuple] = {}
        has = np.zeros(n + 1, np.int64)
        has[hits + 1] = 1
        has = np.cumsum(has)
        starts, spans = [], []
        for span in np.unique(np.minimum(index.span_list, n)).tolist():  # the whole text for longer items
            at = np.flatnonzero(has[span:] > has[:-span])
            starts.append(at)
            spans.append(np.full(len(at), span))
        start, span = np.concatenate(starts), np.concatenate(spans)
        order = np.argsort(start, kind="stable")
        start, span = start[order], span[order]
        for i in range(0, len(start), AT_ONCE):
            self._windows(index, start[i:i + AT_ONCE], span[i:i + AT_ONCE], h, weight, best)
        for row, (similarity, at, distance, words_) in sorted(best.items()):
            yield d, row, -similarity, distance, at, words_

    def _windows(self, index, start, span, h, weight, best) -> None:
        for low, high in self._stretches(start, span):
            a, b = start[low], int((start[low:high] + span[low:high]).max())
            signed = _signs(h[a:b]) * weight[a:b, None]
            sums = np.zeros((b - a + 1, 64), np.int64)
            np.cumsum(signed, axis=0, out=sums[1:])
            first = start[low:high] - a
            sums = sums[first + span[low:high]] - sums[first]
            self._once(h[a:b], signed, first, span[low:high], sums)
            prints = _packed(sums)
            for i, item in zip(*(x.tolist() for x in index.near(prints, span[low:high], len(h)))):
                self._measure(index, item, int(start[low + i]), int(span[low + i]), prints[i], h, weight, best)

    @staticmethod
    def _once(h, signed, first, span, sums) -> None:
        """Take from the sums of windows what repeats a shingle of the same window."""
        order = np.argsort(h, kind="stable")
        same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        again, before = order[same + 1], order[same]  # a repeat, and the previous place of its shingle
        for size in np.unique(span).tolist() if len(again) else ():
            # windows that start in (again - size, before] hold both
            near = again - before < size
            edges = np.concatenate([again[near] - size + 1, before[near] + 1])
            if not len(edges):
                continue
            by_place = np.argsort(edges, kind="stable")
            upto = np.zeros((len(edges) + 1, 64), np.int64)
            np.cumsum(np.concatenate([signed[again[near]], -signed[again[near]]])[by_place], axis=0, out=upto[1:])
            own = np.flatnonzero(span == size)
            sums[own] -= upto[np.searchsorted(edges[by_place], first[own], side="right")]

    @staticmethod
    def _stretches(start, span):
        """Runs of windows that overlap, so that far hits do not sum up what lies between."""
        reach = np.maximum.accumulate(start + span)
        cuts = np.flatnonzero(start[1:] > reach[:-1]) + 1
        edges = [0, *cuts.tolist(), len(start)]
        return zip(edges, edges[1:])

    def _measure(self, index, item, a, span, fingerprint, h, weight, best) -> None:
        row, shingles, total = index.items[item]
        mine = dict(zip(h[a:a + span].tolist(), weight[a:a + span].tolist()))
        both = sum(x for s, x in mine.items() if s in shingles)
        similarity = both / (sum(mine.values()) + total - both)
        if similarity >= SIMILARITY and (row not in best or (-similarity, a) < best[row][:2]):
            best[row] = (-similarity, a, int(np.bitwise_count(fingerprint ^ index.prints[item])), span + index.k - 1)


def blocks(benchmark: DataFrame) -> list[list[tuple]]:
    """Items as (id, text) lists of about BLOCK_WORDS words, one list after the other."""
    items = benchmark.select("item_id", "text").filter("text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+"))).cast("long")).first()[0] or 0
    many = -(-int(total) // BLOCK_WORDS)
    for b in range(many):
        chosen = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == b)
        yield [tuple(r) for r in chosen.orderBy("item_id", "text").collect()]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that match: doc_id, item_id, similarity, hamming,
    first_word (from 0) and n_words of the most similar window."""
    fields = [docs.schema["doc_id"], benchmark.schema["item_id"], T.StructField("similarity", T.DoubleType()),
              T.StructField("hamming", T.IntegerType()), T.StructField("first_word", T.LongType()),
              T.StructField("n_words", T.LongType())]
    schema = T.StructType(fields)
    item_type = to_arrow_type(fields[1].dataType)
    out = docs.sparkSession.createDataFrame([], schema)
    for items in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = None
            for piece in pieces(batches):
                index = index or Benchmark([t for _, t in shared.value])
                found = list(index.matches(piece.column(1)))
                cols = list(zip(*found)) if found else [()] * 6
                ids = piece.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([shared.value[i][0] for i in cols[1]], item_type), pa.array(cols[2], pa.float64()),
                     pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())],
                    names=schema.names)

        out = out.union(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that match no item."""
    index_of_text = docs.columns.index("text")
    for items in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = None
            for piece in pieces(batches):
                index = index or Benchmark([t for _, t in shared.value])
                bad = {m[0] for m in index.matches(piece.column(index_of_text))}
                yield piece.filter(pa.array([i not in bad for i in range(piece.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
