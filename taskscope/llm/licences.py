"""Licence notices by a positional index of rare words, in DataFrame and SQL functions only.

Templates are word sequences.  A first pass counts, over all documents, how many hold
each word of a template; the words of highest IDF of each template become its index,
with their places in the template.  In a document that holds the template's mandatory
key phrase, each occurrence of an indexed word says where the template would start;
starts on which two indexed words agree are aligned word by word, and the share of the
template's IDF that agrees is the score of that start.  A template is found if its
score is `SCORE` or more.

The index has `RARE` words at least, and as many more as it takes that no start can
reach the key phrase's share of the IDF, or `SCORE`, with one indexed word or none.
As the key phrase is part of its template, where it stands is such a start, so the
score is the best of all starts.

Words are runs of ASCII letters and digits (A-Z lower-cased) and characters beyond
ASCII.  A null text is an empty one: no words, no labels, score 0.  Repeated rows,
ties and null ids need no care, as no rows meet; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RARE, SCORE = 3, 0.6

#: Phrases that always count, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label -> (words of the notice, mandatory key phrase), as the licences' texts have them.
TEMPLATES = {
    "agpl-3.0": ("licensed under the gnu affero general public license version 3", "affero general public license"),
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted",
            "redistribution and use in source and binary forms"),
    "cc-by-4.0": ("licensed under cc by 4 0", "cc by 4 0"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "cc by nc 4 0"),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", "cc by sa 4 0"),
    "cc0-1.0": ("the person who associated a work with this deed has dedicated the work to the public domain",
                "dedicated the work to the public domain"),
    "gpl-2.0": ("this work is licensed under the gnu general public license version 2",
                "gnu general public license version 2"),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3",
                "gnu general public license version 3"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee"
            " is hereby granted", "with or without fee is hereby granted"),
    "lgpl": ("licensed under the gnu lesser general public license", "lesser general public license"),
    "mit-notice": ("released under the mit license", "the mit license"),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software and"
                 " associated documentation files", "to any person obtaining a copy"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0",
                "mozilla public license"),
    "unlicense": ("this is free and unencumbered software released into the public domain",
                  "free and unencumbered software"),
}
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def worded(docs: DataFrame) -> DataFrame:
    """doc_id and `w`, the words of each text."""
    lower = F.translate(F.coalesce("text", F.lit("")), LETTERS, LETTERS.lower())
    plain = F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return docs.select("doc_id", F.array_remove(F.split(plain, " "), "").alias("w"))


def _literal(words) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def idf(docs: DataFrame) -> dict[str, float]:
    """IDF of each word of the templates, counted over all documents (as many rows as such words)."""
    vocabulary = sorted({w for text, _ in TEMPLATES.values() for w in text.split()})
    held = worded(docs).select(F.explode(F.concat(F.array(F.lit("")), F.expr(
        f"array_intersect(w, {_literal(vocabulary)})"))).alias("word"))
    counts = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}
    rows = counts.get("", 0)
    return {w: math.log((1 + rows) / (1 + counts.get(w, 0))) + 1 for w in vocabulary}


def index(weights: dict[str, float]) -> dict[str, tuple[list[tuple[str, int]], int]]:
    """Label -> its rare words with their places in the template, rarest first, and on how
    many of them a start has to agree: two, or one where a single word may be enough."""
    out = {}
    for label, (text, phrase) in TEMPLATES.items():
        words = text.split()
        share = {w: weights[w] * words.count(w) for w in words}
        total = sum(share.values())
        least = min(SCORE, sum(weights[w] for w in phrase.split()) / total) * total * (1 - 1e-9)
        rare = sorted(share, key=lambda w: (-weights[w], w))
        # the most that a start can have which agrees on fewer indexed words than asked for
        agree = 2 if max(share.values()) < least else 1
        size = next(n for n in range(1, len(rare) + 1) if sum(share[w] for w in rare[n:]) + (
            max(share[w] for w in rare[:n]) if agree == 2 else 0) < least)
        out[label] = [(w, i) for w in rare[:max(size, RARE)] for i, x in enumerate(words) if x == w], agree
    return out


def _scored(label: str, places: list[tuple[str, int]], agree: int, weights: dict[str, float]) -> str:
    """SQL: best score of one template over all starts that two, or one, of its rare words agree on.

    `rare` holds (word, place) of all indexed words of the document.
    """
    words = TEMPLATES[label][0].split()
    total = sum(weights[w] for w in words)
    per_word = {}
    for w, i in places:
        per_word.setdefault(w, []).append(i)
    lists = [f"flatten(transform(filter(rare, r -> r.x = '{w}'), r -> array({', '.join(f'r.i - {i}' for i in at)})))"
             for w, at in per_word.items()]
    every = f"concat({', '.join(f'array_distinct({x})' for x in lists)})"
    # in the sorted list of all proposed starts, a start that two words propose has an equal neighbour
    starts = f"array_sort({every})"
    chosen = (f"array_distinct(transform(filter(zip_with(slice({starts}, 1, greatest(size({starts}) - 1, 0)),"
              f" slice({starts}, 2, size({starts})), (a, b) -> struct(a, b)), p -> p.a = p.b), p -> p.a))")
    if agree == 1:
        chosen = f"array_distinct({every})"
    match = " + ".join(f"CASE WHEN get(w, s + {j}) = '{x}' THEN {weights[x] / total!r}D ELSE 0D END"
                       for j, x in enumerate(words))
    return f"coalesce(array_max(transform({chosen}, s -> {match})), 0D)"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    weights = idf(docs)
    places = index(weights)
    ends = sorted({p.split()[-1] for p in BASE})
    rare = sorted({w for own, _ in places.values() for w, _ in own} | set(ends))
    # no label without its key phrase, which holds this word
    keys = sorted({max(phrase.split(), key=lambda w: (weights[w], w)) for _, phrase in TEMPLATES.values()} | set(ends))
    d = worded(docs).withColumn("n_words", F.size("w").cast("long"))
    d = d.withColumn("_hit", F.expr(f"arrays_overlap(w, {_literal(keys)})"))
    d = d.withColumn("rare", F.expr(
        f"CASE WHEN _hit THEN filter(transform(w, (x, i) -> struct(x, i)), r -> array_contains({_literal(rare)}, r.x))"
        " ELSE array() END"))
    d = d.withColumn("_text", F.expr("CASE WHEN _hit THEN concat(' ', array_join(w, ' '), ' ') ELSE '' END"))
    for phrase, label in BASE.items():
        words = phrase.split()
        n = len(words)
        same = " AND ".join(f"get(w, r.i - {n - 1 - k}) = '{x}'" for k, x in enumerate(words[:-1]))
        d = d.withColumn(f"_b_{label}", F.expr(
            f"transform(filter(rare, r -> r.x = '{words[-1]}' AND r.i >= {n - 1} AND {same}), r -> r.i - {n - 1})"))
    found = [f"_b_{label}" for label in BASE.values()]
    d = d.withColumn("_at", F.concat(*found))
    d = d.withColumns({f"_s_{k}": F.expr(
        f"CASE WHEN _hit AND contains(_text, ' {TEMPLATES[label][1]} ') THEN {_scored(label, *places[label], weights)}"
        " ELSE 0D END") for k, label in enumerate(TEMPLATES)})
    base = F.expr("array_sort(array_compact(array(" + ", ".join(
        f"CASE WHEN size(_b_{label}) > 0 THEN '{label}' END" for label in BASE.values()) + ")))")
    own = F.expr("array_compact(array(" + ", ".join(
        f"CASE WHEN _s_{k} >= {SCORE} THEN '{label}' END" for k, label in enumerate(TEMPLATES)) + "))")
    return d.select(
        "doc_id", "n_words", F.size("_at").cast("long").alias("n_base"),
        F.array_min("_at").cast("long").alias("first_word"), F.array_max("_at").cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.least(F.lit(1.0), F.greatest(*[F.col(f"_s_{k}") for k in range(len(TEMPLATES))])).alias("score"))
