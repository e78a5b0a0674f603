"""Toxicity by a weighted finite-state grammar over clauses.

A text's clauses are read as symbols: insults with a weight, harm, intent, targets,
negations, verbs of speech, quotation marks, and other words.  Four transducers are
composed, each reading what the one before wrote: negation weakens insults in its
scope; threat turns intent, harm and target into one symbol; target strengthens what
is said to or about somebody; reported speech weakens what is quoted.  A clause's
score is the sum of the weights that are left, a document's evidence the logarithm of
one plus the sum over its clauses, and its score a logistic function of that.

Insults are learned from labelled rows: words, and stems of 4 to 8 letters, that at
least `SUPPORT` of the toxic texts hold and that are far rarer in others; of these the
ones that are nearly never found elsewhere, and those that explain what no better one
explains, as copies of one toxic text share many harmless words.  Of all
labelled rows that may be learned from, the `FIT_ROWS` with the smallest hash of
their id are used; nothing else of a row but its text is an input of a score.

A null text is an empty one and gets the score of a text without matches.  Null
labels and labels of unknown documents teach nothing; repeated texts teach once; without toxic or clean examples every score is 0.  An empty table
gives an empty result; other columns are ignored or kept as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskscope.llm.words import pieces
from taskscope.session import cut

FIT_ROWS, SUPPORT, LEAST_WEIGHT = 8000, 0.01, 2.0
#: Words of at least this share of toxic texts, with at most this share of clean holders, count by themselves.
CLEAR = 0.02
THRESHOLD = 0.3
#: Counted examples are handed on when a task holds so many.
HELD = 200_000

INSULT, HARM, INTENT, TARGET, NEGATION, SPEECH, QUOTE, OTHER, THREAT = "IHMTNRQOX"
#: Closed word classes.
CLASSES = {
    HARM: "kill hurt beat stab shoot destroy murder strangle töten umbringen verletzen tuer frapper matar golpear",
    INTENT: "will shall gonna going must should werde vais voy",
    TARGET: "you your yours yourself u him her them they du dich dir ihr euch toi vous tu te ti usted ustedes",
    NEGATION: "not no never nobody isn't aren't don't nicht kein keine nie pas jamais nunca ningún",
    SPEECH: "said says saying told wrote called quoted claimed sagte sagt schrieb dit disait dijo dice escribió",
}
_CLASS = {w: c for c, words in CLASSES.items() for w in words.split()}
_CLAUSE = re.compile(r"[^.!?;:\n]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:'t)?|[\"“”„«»]")
_WORD = re.compile(r"[^\W\d_]+")


class Transducer:
    """Arcs (state, symbol) -> (state, symbol written, factor); other symbols pass as `rest` says."""

    def __init__(self, arcs: dict, rest: dict):
        self.arcs, self.rest = arcs, rest

    def step(self, state, symbol):
        found = self.arcs.get((state, symbol))
        return found if found else (self.rest.get(state, state), symbol, 1.0)


def _scope(opens: str, length: int, factor: float) -> Transducer:
    """What `opens` weakens or strengthens insults in the next `length` symbols."""
    arcs = {(s, opens): (length, opens, 1.0) for s in range(length + 1)}
    arcs |= {(s, INSULT): (s - 1, INSULT, factor) for s in range(1, length + 1)}
    return Transducer(arcs, {s: max(s - 1, 0) for s in range(length + 1)})


def _threats() -> Transducer:
    """Intent, then harm, then a target, each within four words of the one before."""
    arcs = {((k, s), INTENT): ((1, 4), OTHER, 1.0) for k in (0, 1, 2) for s in range(5)}
    arcs |= {((1, s), HARM): ((2, 4), OTHER, 1.0) for s in range(5)}
    arcs |= {((2, s), TARGET): ((0, 0), THREAT, 1.0) for s in range(5)}
    return Transducer(arcs, {(k, s): (k, s - 1) if s > 1 else (0, 0) for k in (0, 1, 2) for s in range(5)})


def _reported() -> Transducer:
    """A verb of speech holds to the clause's end, a quotation mark to the next one."""
    arcs = {}
    for s in (0, 1, 2):
        arcs[(s, SPEECH)] = (max(s, 1), SPEECH, 1.0)
        arcs[(s, QUOTE)] = (0 if s == 2 else 2, QUOTE, 1.0)
        arcs[(s, INSULT)] = (s, INSULT, 0.5 if s else 1.0)
        arcs[(s, THREAT)] = (s, THREAT, 0.5 if s else 1.0)
    return Transducer(arcs, {})


#: In the order of composition, with the state each begins in.
GRAMMAR = [(_scope(NEGATION, 3, 0.3), 0), (_threats(), (0, 0)), (_scope(TARGET, 4, 1.3), 0), (_reported(), 0)]
THREAT_WEIGHT = 4.0


def clause_score(symbols: list[tuple[str, float]]) -> float:
    """Sum of weights along the composition of all transducers."""
    states = [start for _, start in GRAMMAR]
    total = 0.0
    for symbol, weight in symbols:
        for k, (machine, _) in enumerate(GRAMMAR):
            states[k], symbol, factor = machine.step(states[k], symbol)
            weight *= factor
            if symbol == THREAT and not weight:
                weight = THREAT_WEIGHT
        if symbol in (INSULT, THREAT):
            total += weight
    return total


@dataclass
class Model:
    """Weights of whole words and of stems (these end in `*`), and the logistic function."""

    weights: dict[str, float]
    bias: float = -20.0
    slope: float = 0.0

    def reader(self) -> "Reader":
        return Reader(self)


class Reader:
    def __init__(self, model: Model):
        self.model = model
        self.find = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for key, weight in model.weights.items():
            entries.setdefault(key.rstrip("*"), []).append((key.endswith("*"), weight))
        for word in CLASSES[HARM].split():
            entries.setdefault(word, []).append((False, 0.0))
        for word, found in entries.items():
            self.find.add_word(word, (len(word), found))
        self.find.make_automaton()

    def evidence(self, text: str) -> float:
        low = text.lower()
        hits: dict[int, float] = {}
        for end, (size, found) in self.find.iter(low):
            start = end - size + 1
            if start and low[start - 1].isalpha():
                continue
            whole = end + 1 == len(low) or not low[end + 1].isalpha()
            for stem, weight in found:
                if stem or whole:
                    hits[start] = max(weight, hits.get(start, 0.0))
        if not hits:
            return 0.0
        places = sorted(hits)
        total, k = 0.0, 0
        for clause in _CLAUSE.finditer(low):
            if k < len(places) and places[k] < clause.end():
                while k < len(places) and places[k] < clause.end():
                    k += 1
                total += clause_score([self._symbol(m, hits) for m in
                                       _TOKEN.finditer(low, clause.start(), clause.end())])
        return math.log1p(total)

    @staticmethod
    def _symbol(m: re.Match, hits: dict[int, float]) -> tuple[str, float]:
        weight = hits.get(m.start(), 0.0)
        if weight:
            return INSULT, weight
        word = m.group()
        return (QUOTE if word in '"“”„«»' else _CLASS.get(word, OTHER)), 0.0

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(min(700.0, -self.model.bias - self.model.slope * self.evidence(text))))


def features(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in range(4, min(8, len(w)) + 1)}


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic and text of at most FIT_ROWS labelled rows that are not held out."""
    chosen = (labels.filter(F.col("toxic").isNotNull() & ~held_out())
              .select(F.col("doc_id").alias("_id"), (F.col("toxic") != 0).alias("toxic"))
              .orderBy(F.xxhash64("_id"), "_id", "toxic").limit(FIT_ROWS))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")) \
        .select("toxic", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(counts):
        keys = list(counts[0] | counts[1])
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)],
            names=["feature", "clean", "toxic"])

    counts = (Counter(), Counter())
    for piece in pieces(batches):
        for toxic, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
            counts[toxic].update(features(text))
            counts[toxic][""] += 1
            if len(counts[0]) + len(counts[1]) > HELD:
                yield out(counts)
                counts = (Counter(), Counter())
    yield out(counts)


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array([reader.evidence(t) for t in piece.column(1).to_pylist()], pa.float64())],
                names=["toxic", "x"])
    return run


def _held(keys: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array([sorted(features(t) & keys) for t in piece.column(1).to_pylist()],
                                           pa.list_(pa.string()))], names=["toxic", "keys"])
    return run


def _cover(held: list[tuple[bool, list[str]]], least: float) -> set[str]:
    """Keys that explain toxic examples no better key explains: greedily, each the one that adds
    most toxic examples less clean ones, until one adds fewer than `least`."""
    holders: dict[str, tuple[set[int], set[int]]] = {}
    for i, (toxic, keys) in enumerate(held):
        for k in keys:
            holders.setdefault(k, (set(), set()))[toxic].add(i)
    chosen: set[str] = set()
    while holders:
        best = max(holders, key=lambda k: (len(holders[k][1]) - len(holders[k][0]), k))
        clean, toxic = holders.pop(best)
        if len(toxic) - len(clean) < least:
            break
        chosen.add(best)
        clean, toxic = set(clean), set(toxic)
        for c, t in holders.values():
            c -= clean
            t -= toxic
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope of a logistic regression with a weak pull of the slope to zero."""
    b, s = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(b + s * x, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([(y - p).sum(), ((y - p) * x).sum() - 0.1 * s])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.1]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        b, s = b + step[0], s + step[1]
        if abs(step).max() < 1e-8:
            break
    return float(b), float(s)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from a bounded sample; what comes to the driver is bounded by it."""
    sample = examples(docs, labels)
    counted = (sample.mapInArrow(_counted, "feature string, clean long, toxic long").groupBy("feature")
               .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    counted = cut(counted.filter("toxic >= 3 OR feature = ''"))
    total = counted.filter("feature = ''").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return Model({})
    least = max(3.0, SUPPORT * total["toxic"])
    odds = math.log(total["clean"] / total["toxic"])
    rows = {r["feature"]: r for r in counted.filter((F.col("toxic") >= least) & (F.col("feature") != "")
                                                    & (F.col("toxic") > F.col("clean"))).collect()}
    weights = {}
    for key, r in rows.items():
        weight = math.log(r["toxic"] / (r["clean"] + 3)) + odds
        if weight < LEAST_WEIGHT:
            continue
        if key.endswith("*"):  # a longer stem with the same support says it more exactly
            longer = [o for o in rows if o.endswith("*") and len(o) == len(key) + 1 and o.startswith(key[:-1])]
            if any(rows[o]["toxic"] >= 0.9 * r["toxic"] for o in longer):
                continue
        weights[key] = weight
    held = sample.mapInArrow(_held(set(weights)), "toxic boolean, keys array<string>").collect()
    clear = {k for k in weights if rows[k]["toxic"] >= CLEAR * total["toxic"] and rows[k]["clean"] <= CLEAR * rows[k]["toxic"]}
    chosen = clear | _cover([(r["toxic"], r["keys"]) for r in held], least / 3)
    model = Model({k: weights[k] for k in chosen})
    pairs = sample.mapInArrow(_evidence(model), "toxic boolean, x double").collect()
    model.bias, model.slope = _logistic(np.array([r["x"] for r in pairs]),
                                        np.array([float(r["toxic"]) for r in pairs]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from THRESHOLD on)."""
    kind = docs.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for piece in pieces(batches):
            scores = [reader.score(t or "") for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores, pa.float64())],
                                             names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, T.StructType([kind, T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns, whose score is below THRESHOLD."""
    index = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for piece in pieces(batches):
            good = [reader.score(t or "") < THRESHOLD for t in piece.column(index).to_pylist()]
            yield piece.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
