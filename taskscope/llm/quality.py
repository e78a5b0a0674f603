"""Quality rules as a short-circuit cascade, in DataFrame and SQL functions only.

Every rule is a condition that rejects.  On a sample of at most `SAMPLE` rows each
rule is timed and its rejections are counted; rules run in order of rejections per
second, and a document leaves the cascade at its first rejection.  The order decides
how much work is done, never the verdict.

A null text is an empty one: no words, so it fails the base rules.  Repeated rows,
ties and null ids need no care, as no rows meet; an empty table gives an empty result
(rules then keep their given order).  Other columns are ignored; names of the result
are the operator's own.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskscope.session import cut

SAMPLE = 2000

#: Name -> rejecting condition over `t` (text), `w` (words) and the base measures.
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
    "digits": "10 * (char_length(t) - char_length(translate(t, '0123456789', ''))) > 3 * char_length(t)",
    "capitals": r"2 * char_length(regexp_replace(t, '[^\\p{Lu}]+', ''))"
                r" > char_length(regexp_replace(t, '[^\\p{L}]+', ''))",
    "without_letters": r"10 * size(array_remove(split(regexp_replace(t, '[^\\p{L}\\x20\\x09-\\x0D]+', ''),"
                       r" '[\\x20\\x09-\\x0D]+'), '')) < 8 * n_words",
    "cut_lines": r"10 * size(filter(split(t, '\n'), x -> x rlike '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')) > 3 * n_lines",
    "bullets": r"10 * size(filter(split(t, '\n'), x -> x rlike '^[\\x20\\x09-\\x0D]*[-*•]')) > 9 * n_lines",
}

_WHITE = "'\t\n\x0b\x0c\r'"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, `t`, `w` and the base measures of each row."""
    d = docs.select("doc_id", F.expr("coalesce(text, '') AS t"))
    d = d.select("*", F.expr(f"array_remove(split(translate(t, {_WHITE}, '     '), ' '), '') AS w"),
                 F.expr(f"filter(split(t, '\\n'), x -> trim(BOTH concat(' ', {_WHITE}) FROM x) <> '') AS _lines"))
    d = d.select("doc_id", "t", "w", F.size("w").cast("long").alias("n_words"),
                 F.size("_lines").cast("long").alias("n_lines"),
                 F.expr("char_length(array_join(w, '')) AS word_chars").cast("long"),
                 F.expr("char_length(t) - char_length(translate(t, '#*$%&|<>', '')) AS n_symbols").cast("long"),
                 F.expr("size(_lines) - size(array_distinct(_lines)) AS n_dup_lines").cast("long"))
    # words in windows of three that are found again: a window's hash and place share a number,
    # whose low bits hold the place, so equal windows are neighbours once these are sorted
    d = d.withColumn("_p", F.expr("length(bin(n_words))"))
    d = d.withColumn("_s", F.expr(
        "CASE WHEN n_words < 3 THEN array() ELSE sort_array(transform(sequence(0, size(w) - 3),"
        " i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), _p) | i)) END"))
    def place(x):
        return f"CAST({x} & (shiftleft(1L, _p) - 1) AS INT)"

    def same(y):
        """x and y have equal hashes and equal words."""
        words = " AND ".join(f"w[{place('x')} + {k}] = w[{place(y)} + {k}]" for k in range(3))
        return f"shiftright(x, _p) = shiftright({y}, _p) AND {words}"

    d = d.withColumn("_d", F.expr(
        f"sort_array(transform(filter(_s, (x, k) -> (k > 0 AND {same('_s[k - 1]')})"
        f" OR (k < size(_s) - 1 AND {same('_s[k + 1]')})), x -> {place('x')}))"))
    covered = ("CASE WHEN size(_d) = 0 THEN 0 ELSE aggregate(zip_with(slice(_d, 2, size(_d)),"
               " slice(_d, 1, size(_d) - 1), (a, b) -> least(3, a - b)), 3, (n, x) -> n + x) END")
    d = d.withColumn("n_repeat_words", F.expr(covered).cast("long"))
    return d.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")) \
        .drop("_p", "_s", "_d")


def ordered_rules(docs: DataFrame, rules: dict[str, str] = RULES) -> list[tuple[str, float, float]]:
    """(rule, share rejected, seconds) on the sample, most rejections per second first."""
    rows = docs.count()
    if not rows:
        return [(name, 0.0, 0.0) for name in rules]
    # a rule's own work, without the base measures that all rows need anyway
    sample = cut(measured(docs.sample(False, min(1.0, 2 * SAMPLE / rows), seed=7).limit(SAMPLE)))
    sample = sample.filter("NOT base_failed")

    def timed(condition: str) -> tuple[float, int, int]:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            n, hits = sample.agg(F.count(F.lit(1)), F.count_if(F.expr(condition))).first()
            best = min(best or 1e9, time.perf_counter() - start)
        return best, n, hits

    idle, n, _ = timed("false")
    found = []
    for name, condition in rules.items():
        seconds, _, hits = timed(condition)
        found.append((name, hits / max(n, 1), max(seconds - idle, 1e-4)))
    return sorted(found, key=lambda r: (-r[1] / r[2], r[2]))


def cascade(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """doc_id, base measures, `base_failed`, and `kept`: no rule rejects."""
    steps = " ".join(f"WHEN {rules[name]} THEN false" for name, _, _ in ordered_rules(docs, rules))
    return measured(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                 "base_failed", F.expr(f"CASE WHEN base_failed THEN false {steps} ELSE true END")
                                 .alias("kept"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)),
                              lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g) WHERE k > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, range(3) AS o(j) GROUP BY doc_id),
m AS (SELECT doc_id, t, w, len(l) AS n_lines, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 12 * n_words
            OR 10 * length(regexp_replace(t, '[^0-9]', '', 'g')) > 3 * length(t)
            OR 2 * length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) > length(regexp_replace(t, '[^\p{L}]', '', 'g'))
            OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) < 8 * n_words
            OR 10 * len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 3 * n_lines
            OR 10 * len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) > 9 * n_lines
       ) AS kept
FROM b"""
