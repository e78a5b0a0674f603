"""Tokens of each section of a document, from one encoding of the whole document.

A document is encoded once; its tokens are character spans, and so are its sections.
Spans of tokens are joined with the sections they meet, both in order of place.  A
token that crosses a boundary goes by a stated rule:

`first`     to the section that holds its first character;
`most`      to the section that holds most of its characters, the first of equals;
`share`     to each section, in proportion to its characters.

A token that begins within a character counts with the character it ends in.  Tokens
outside all sections are counted as section null.  Sections may not overlap.

A null or empty text has no tokens and no sections, so no rows.  Repeated rows give
repeated results; a null id stays null; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from taskscope.llm.bpe import char_ends, codec
from taskscope.llm.words import pieces, utf8

RULES = ("first", "most", "share")


def lines(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sections of a text's characters: its lines, each with the line feed that ends it."""
    ends = np.append(np.flatnonzero(chars == 0x0A) + 1, len(chars))
    ends = np.unique(ends[ends > 0])
    return np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)


def attributed(begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray,
               rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section [low, high), the last entry for none, and how many tokens cross its bounds.

    begin, end: character spans of tokens, in order and at least one character long.
    """
    n = len(low)
    first = np.searchsorted(high, begin, side="right")  # first section that ends after the token begins
    last = np.searchsorted(low, end, side="left") - 1  # last section that begins before it ends
    meets = np.maximum(last - first + 1, 0)
    token = np.repeat(np.arange(len(begin)), meets)
    upto = np.cumsum(meets)
    section = np.repeat(first - upto + meets, meets) + np.arange(len(token))
    shared = np.minimum(end[token], high[section]) - np.maximum(begin[token], low[section])
    size = (end - begin)[token]
    if rule == "share":
        count = np.bincount(section, shared / size, minlength=n + 1)
        count[n] = len(begin) - count.sum()
    else:
        if rule == "first":
            mine = (low[section] <= begin[token]) & (begin[token] < high[section])
        else:
            order = np.lexsort((section, -shared, token))
            top = np.ones(len(order), bool)
            top[1:] = token[order][1:] != token[order][:-1]
            mine = np.zeros(len(order), bool)
            mine[order[top]] = True
        count = np.bincount(section[mine], minlength=n + 1).astype(np.float64)
        count[n] = len(begin) - mine.sum()
    crossing = np.bincount(section[shared < size], minlength=n + 1)
    return count, crossing


def section_tokens(docs: DataFrame, path: str, sections: Callable = lines, rule: str = "first") -> DataFrame:
    """doc_id, section (from 0; null for none), first_char, end_char, n_tokens, n_crossing.

    `sections` gets the code points of a text and returns starts and ends in order.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("section", T.LongType()),
                           T.StructField("first_char", T.LongType()), T.StructField("end_char", T.LongType()),
                           T.StructField("n_tokens", T.DoubleType() if rule == "share" else T.LongType()),
                           T.StructField("n_crossing", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for piece in pieces(batches):
            texts = piece.column(1)
            data, offsets = utf8(texts)
            t = own.encode(texts)
            chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            first_char = char_ends(data, offsets)
            ends = char_ends(data, t.ends)
            out = [[], [], [], [], [], []]
            for d in range(len(texts)):
                a, b = first_char[d], first_char[d + 1]
                if a == b:
                    continue
                low, high = sections(chars[a:b])
                end = ends[t.first[d]:t.first[d + 1]] - a
                begin = np.minimum(np.concatenate([[0], end[:-1]]), end - 1)
                count, crossing = attributed(begin, end, low, high, rule)
                keep = np.ones(len(low) + 1, bool)
                keep[-1] = count[-1] > 1e-9
                k = int(keep.sum())
                for column, values in zip(out, (
                        np.full(k, d), np.where(np.arange(len(keep)) < len(low), np.arange(len(keep)), -1)[keep],
                        np.append(low, -1)[keep], np.append(high, -1)[keep], count[keep], crossing[keep])):
                    column.append(values)
            row, section, low, high, count, crossing = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
            none = section < 0
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(pa.array(row, pa.int64())),
                 *(pa.array(c, pa.int64(), mask=none) for c in (section, low, high)),
                 pa.array(count if rule == "share" else count.astype(np.int64)), pa.array(crossing, pa.int64())],
                names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
