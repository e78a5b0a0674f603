"""Personal data by patterns, and by a skip-chain conditional random field over what is left.

Patterns find e-mail addresses, IP addresses, card and phone numbers; these spans
always stay.  Tokens with a digit or an `@` are the variables of the field, labelled
with a kind or none.  Single potentials come from a token's shape and neighbours,
chain potentials from adjacent labels; both are counted over all documents, whose
labels the patterns give (`secret` has seed patterns of its own), so files and
partitions do not matter.  A feature comes to the driver if two tokens or more have it
and it is `SUPPORT` or more of the tokens of some label, however rare that label is:
with seven features a token at most 350,000 a label, in tables of any size.  Skip potentials tie tokens of the same form, or of the same last digits, over
any distance: each form that repeats is a variable without evidence of its own, tied
to all its occurrences, so two of them are equally close wherever they stand.  Tokens
in pattern spans are observed; loopy message passing then settles the others of the
document: until no message moves by `STILL`, within rounds that follow the longest run
of neighbours up to `REACH`, beyond which chain potentials carry nothing.  A token
whose belief in a kind is `SURE` or more is added; neighbours of one kind make one span.

A token has at most two chain and two skip edges, so a text with one number a thousand
times stays linear.

A null or empty text has no spans.  Rows are independent: repeated rows and null ids
need no care; an empty table gives an empty result; other columns are ignored or kept.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskscope.llm.words import pieces

KINDS = ["email", "ip", "card", "phone", "secret"]
NONE = len(KINDS)
SURE, ROUNDS = 0.95, 15
SUPPORT = 2e-5
STILL, REACH = 1e-4, 250
SAME, ALIKE, UNSEEN = 3.0, 2.0, 6.0

_SOME = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What seeds `secret` where the field is fitted.
_SEED = re.compile(r"(?:(?i:password|passwd|token|secret|api_?key)\s*[=:]\s*\"?)([0-9A-Za-z]{12,})|\b(AKIA[0-9A-Z]{16})\b")
_TOKEN = re.compile(r"[^\s\"'<>=:,;()\[\]{}|]+")

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def patterns(text: str) -> list[Span]:
    """Spans of the four patterns, leftmost and without overlap per kind, in order."""
    if not _SOME.search(text):
        return []
    out = []
    done = 0
    at = text.find("@")
    while at >= 0:  # a match holds one @, and what can stand before it has none
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def shape(token: str) -> str:
    """Digits as 9 with the length of their run, letters as a or A, the rest as it is."""
    out = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|.", token):
        g = m.group()
        if g[0].isdigit():
            out.append(f"9{min(len(g), 20)}")
        elif g[0].isalpha():
            out.append("A" if g.isupper() else "a")
        else:
            out.append(g)
    return "".join(out[:12])


def _valid(word: str, digits: str) -> list[str]:
    """What the checks of cards and addresses say of a token that looks like one."""
    if 14 <= len(digits) <= 19:
        return [f"luhn {luhn(digits)}"]
    parts = word.split(".")
    if len(parts) == 4 and all(p and len(p) < 20 and not p.strip("0123456789") for p in parts):
        return [f"octets {all(int(p) <= 255 for p in parts)}"]
    return []


@dataclass
class Token:
    start: int
    end: int
    text: str
    features: list[str]


def tokens(text: str) -> list[Token]:
    """Tokens with a digit or an @, without the full stop that ends a sentence, with features."""
    out, last = [], ""
    before = 0
    for m in _TOKEN.finditer(text):
        word = m.group().rstrip(".!?")
        if word and _SOME.search(word):
            lead = text[max(before, m.start() - 2):m.start()].strip()
            digits = _digits(word)
            out.append(Token(m.start(), m.start() + len(word), word, [
                f"shape {shape(word)}", f"digits {min(len(digits), 20)} {len(digits) == len(word)}",
                f"size {min(len(word) // 4, 8)} {'@' in word} {word.count('.')}",
                f"left {last.lower() if not _SOME.search(last) else shape(last)}", f"mark {lead}",
                f"head {word[:4]}", *_valid(word, digits)]))
        last, before = word, m.end()
    return out


def _observed(found: list[Token], spans: list[Span]) -> list[int | None]:
    """The kind of the span that holds each token, if one does."""
    out: list[int | None] = [None] * len(found)
    starts = [t.start for t in found]
    for a, b, kind in spans:
        i = max(bisect_right(starts, a) - 1, 0)
        while i < len(found) and found[i].start < b:
            if found[i].end > a and out[i] is None:
                out[i] = kind
            i += 1
    return out


@dataclass
class Field:
    """Counts of (feature, label), of labels, and of neighbouring labels."""

    single: dict[str, np.ndarray]
    prior: np.ndarray
    chain: np.ndarray

    def potentials(self, found: list[Token]) -> np.ndarray:
        out = np.tile(np.log(self.prior), (len(found), 1))
        for i, t in enumerate(found):
            for f in t.features:
                if f in self.single:
                    out[i] += self.single[f]
            if t.features[0] not in self.single:  # a shape that was never seen speaks for no kind
                out[i, NONE] += UNSEEN
        return out

    def added(self, text: str, spans: list[Span]) -> list[Span]:
        """Spans that message passing adds to those of the patterns."""
        found = tokens(text)
        if not found:
            return []
        observed = _observed(found, spans)
        phi = self.potentials(found)
        for i, kind in enumerate(observed):
            if kind is not None:
                phi[i] = -50.0
                phi[i, kind] = 0.0
        edges, pair = [], []
        run = longest = 0
        for i in range(len(found) - 1):
            run = run + 1 if found[i + 1].start - found[i].end <= 3 else 0
            longest = max(longest, run)
            if run:
                edges.append((i, i + 1))
                pair.append(self.chain)
        nodes = len(found)
        for strength, form in ((SAME, lambda t: t.text.lower()), (ALIKE, _tail)):
            places: dict[str, list[int]] = {}
            for i, t in enumerate(found):
                if key := form(t):
                    places.setdefault(key, []).append(i)
            tie = _over_hub(strength) * np.eye(NONE + 1)
            for at in places.values():
                if len(at) > 1:
                    edges += [(i, nodes) for i in at]
                    pair += [tie] * len(at)
                    nodes += 1
        phi = np.concatenate([phi, np.zeros((nodes - len(found), NONE + 1))])
        belief = self._settled(phi, edges, pair, ROUNDS + 4 * min(longest + 8, REACH))
        out: list[Span] = []
        for i, t in enumerate(found):
            kind = int(belief[i].argmax())
            if kind != NONE and observed[i] is None and belief[i, kind] >= SURE:
                if out and out[-1][2] == kind and not text[out[-1][1]:t.start].strip(" ()-."):
                    out[-1] = (out[-1][0], t.end, kind)
                else:
                    out.append((t.start, t.end, kind))
        return [s for s in out if not any(s[0] < b and a < s[1] for a, b, _ in spans)]

    @staticmethod
    def _settled(phi: np.ndarray, edges: list, pair: list, rounds: int) -> np.ndarray:
        """Beliefs when the messages of damped sum-product rest, or after that many rounds."""
        if edges:
            a, b = np.array(edges).T
            psi = np.array(pair)
            src, dst = np.concatenate([a, b]), np.concatenate([b, a])
            both = np.concatenate([psi, psi.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            messages = np.zeros((len(src), phi.shape[1]))
            for _ in range(rounds):
                total = phi.copy()
                np.add.at(total, dst, messages)
                cavity = total[src] - messages[back]
                new = _logsum((cavity[:, :, None] + both), 1)
                new -= _logsum(new, 1)[:, None]
                moved = np.abs(new - messages).max()
                messages = 0.5 * messages + 0.5 * new
                if moved < STILL:
                    break
            phi = phi.copy()
            np.add.at(phi, dst, messages)
        return np.exp(phi - _logsum(phi, 1)[:, None])


def _over_hub(strength: float) -> float:
    """Strength of two edges that tie their ends over a variable between them as one edge would."""
    e, k = math.exp(strength), NONE + 1
    return math.log(e + math.sqrt(e * e + e * (k - 2) - (k - 1)))  # (x^2 + k - 1) / (2 x + k - 2) = e


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _tail(t: Token) -> str:
    digits = _digits(t.text)
    return digits[-7:] if len(digits) >= 7 else ""


#: Counts that a task holds before it passes them on.
_HELD = 1 << 17


def _batch(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([f for f, _ in counts], pa.string()), pa.array([k for _, k in counts], pa.int32()),
         pa.array(list(counts.values()), pa.int64())], names=["feature", "kind", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for piece in pieces(batches):
        for text in piece.column(0).to_pylist():
            if not text or not _SOME.search(text):
                continue
            seeds = [(*m.span(1 if m.group(1) else 2), 4) for m in _SEED.finditer(text)]
            found = tokens(text)
            labels = [NONE if k is None else k for k in _observed(found, patterns(text) + seeds)]
            for t, k in zip(found, labels):
                counts["", k] += 1
                counts.update((f, k) for f in t.features)
            for i in range(len(found) - 1):
                if found[i + 1].start - found[i].end <= 3:
                    counts[f"\t{labels[i]}", labels[i + 1]] += 1
            if len(counts) > _HELD:
                yield _batch(counts)
                counts.clear()
    yield _batch(counts)


def fit(docs: DataFrame) -> Field:
    """Count potentials over all documents; what comes to the driver is bounded by `SUPPORT`."""
    k = NONE + 1
    prior, chain = np.full(k, 1.0), np.full((k, k), 1.0)
    counted = (docs.select("text").mapInArrow(_counted, "feature string, kind int, n long").groupBy("feature")
               .agg(*[F.sum(F.when(F.col("kind") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(k)]))
    counted = counted.persist()  # labels are counted before features are chosen
    labels = F.col("feature") == ""
    pairs = F.col("feature").startswith("\t")
    for feature, *n in counted.filter(labels | pairs).collect():
        if feature:
            chain[int(feature[1:])] += n
        else:
            prior += n
    total = prior.copy()
    often = [F.col(f"n{i}") >= max(1.0, SUPPORT * float(total[i])) for i in range(k)]
    chosen = counted.filter(~labels & ~pairs & (sum(F.col(f"n{i}") for i in range(k)) > 1))
    features, *columns = chosen.filter(reduce(or_, often)).toArrow().columns
    counted.unpersist()
    single = dict(zip(features.to_pylist(), np.array([c.to_numpy() for c in columns], float).T))
    prior /= prior.sum()
    # how much more likely a feature is under a label than at large, with weak counts held back
    single = {f: np.log((c + c.sum() * prior * 0.05 + 0.05) / (total + 0.05)
                        / ((c.sum() + 0.3) / total.sum())) for f, c in single.items()}
    rowed = chain / chain.sum(axis=1, keepdims=True)
    return Field(single, prior, np.clip(np.log(rowed / (chain.sum(axis=0) / chain.sum())), -2, 2))


def spans_of(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Spans of the patterns, and all spans."""
    base = patterns(text)
    more = field.added(text, base) if _SOME.search(text) else []
    return base, sorted(base + more, key=lambda s: (s[0], s[2]))


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the patterns' spans, and all spans."""
    names = [f"n_{k}" for k in KINDS[:4]]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in names],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            counts, digests, every = [], [], []
            for text in piece.column(1).to_pylist():
                base, found = spans_of(text or "", field)
                by = Counter(k for _, _, k in base)
                counts.append([by[k] for k in range(4)])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                every.append(written(found))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)),
                 pa.array(digests, pa.string()), pa.array(every, pa.string())],
                names=["doc_id", *names, "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def masked(docs: DataFrame, field: Field) -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; null texts stay null."""
    index = docs.columns.index("text")
    resize = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def mask(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for a, b, kind in spans_of(text, field)[1]:
            if b <= at:
                continue
            out += [text[at:max(a, at)], f"[{KINDS[kind]}]" if a >= at else ""]
            at = b
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            texts = [mask(t) for t in piece.column(index).to_pylist()]
            columns = list(piece.columns)
            columns[index] = pa.array(texts, pa.string())
            if resize is not None:
                old = columns[resize]
                columns[resize] = pa.array([o if t is None else len(t) for o, t in zip(old.to_pylist(), texts)], old.type)
            yield pa.RecordBatch.from_arrays(columns, names=piece.schema.names)

    return docs.mapInArrow(run, docs.schema)
