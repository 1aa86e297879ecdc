"""Quality rules as a short-circuit cascade.

A sample of rows of about fixed size shows what each rule costs and how much of what reaches it it rejects.
Rules then run in order of rejection per cost, each only on the rows that all rules before it have
passed.  A verdict is the conjunction of all rules, so the order changes the work and never the
result.  Rules compare integers.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _stats as S
from ._core import Words, text_of, word_blocks

SAMPLE_ROWS = 400


@dataclass(frozen=True)
class Rule:
    """A named test of some rows: rejects(words, base) gives a mask, base holds the base statistics by name."""

    name: str
    rejects: Callable[[Words, dict[str, np.ndarray]], np.ndarray]


def _symbols(w, b):
    return 10 * b["n_symbols"] > 3 * b["n_words"]


def _word_length(w, b):
    return (b["word_chars"] < 2 * b["n_words"]) | (b["word_chars"] > 25 * b["n_words"])


def _line_copies(w, b):
    return 2 * b["n_dup_lines"] > S.lines(w)[0]


def _upper(w, b):
    return 2 * S.byte_counts(w, "upper_digits")[0] > b["word_chars"]


def _digits(w, b):
    return 10 * S.byte_counts(w, "upper_digits")[1] > 3 * b["word_chars"]


def _adjacent(w, b):
    return 5 * S.adjacent_repeats(w, w.hashes()) > b["n_words"]


def _distinct(w, b):
    return 50 * S.distinct_words(w, w.hashes()) < b["n_words"]


RULES = (Rule("symbols", _symbols), Rule("word_length", _word_length), Rule("line_copies", _line_copies), Rule("upper", _upper), Rule("digits", _digits), Rule("adjacent", _adjacent), Rule("distinct", _distinct))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_statistics(w: Words) -> dict[str, np.ndarray]:
    chars, symbols = S.byte_counts(w, "chars_symbols")
    return {"n_words": w.count, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": S.lines(w)[1], "n_repeat_words": S.repeated_words(w, w.hashes())}


def base_failed(b: dict[str, np.ndarray]) -> np.ndarray:
    return (b["n_words"] < 50) | (100 * b["n_repeat_words"] > 50 * b["n_words"])


def _subset(w: Words, rows: np.ndarray) -> Words:
    """The Words of some rows only."""
    if len(rows) == len(w.count):
        return w
    size = np.diff(w.offsets)[rows]
    at = np.concatenate(([0], np.cumsum(size)))
    take = np.repeat(w.offsets[rows] - at[:-1], size) + np.arange(at[-1])
    return Words(w.raw[take], at)


def cascade(w: Words, base: dict[str, np.ndarray], alive: np.ndarray, rules) -> np.ndarray:
    """Rows of alive that every rule passes; a rule sees only what is left."""
    rows = np.flatnonzero(alive)
    for rule in rules:
        if not len(rows):
            break
        rows = rows[~rule.rejects(_subset(w, rows), {k: v[rows] for k, v in base.items()})]
    out = np.zeros(len(alive), bool)
    out[rows] = True
    return out


def _profile(rules, most: int):
    """Seconds and rejections of each rule on the first rows of a partition, most at most; the rest is not read."""

    def run(batches):
        for b in itertools.islice(batches, 1):
            b = b.slice(0, most)
            for _, _, w in word_blocks(b.column(0)):
                base = base_statistics(w)
                rows = np.flatnonzero(~base_failed(base))
                if not len(rows):
                    continue
                sub, part = _subset(w, rows), {k: v[rows] for k, v in base.items()}
                for rule in rules:
                    began = time.perf_counter()
                    hits = int(rule.rejects(sub, part).sum())
                    yield pa.RecordBatch.from_pydict({"rule": [rule.name], "seconds": [time.perf_counter() - began], "hits": [hits], "n": [len(rows)]}, schema=pa.schema([("rule", pa.string()), ("seconds", pa.float64()), ("hits", pa.int64()), ("n", pa.int64())]))

    return run


def order_rules(texts: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejected rows per second on the first rows of every partition, about sample_rows in all (one a partition at least).

    The sample decides nothing but the order."""
    each = -(-sample_rows // max(1, texts.rdd.getNumPartitions()))
    got = texts.mapInArrow(_profile(rules, each), "rule string, seconds double, hits bigint, n bigint").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("hits").alias("h")).collect()
    gain = {r["rule"]: r["h"] / max(r["s"], 1e-9) for r in got}
    return sorted(rules, key=lambda r: -gain.get(r.name, 0.0))


def _judge(rules):
    def run(batches):
        for b in batches:
            for lo, hi, w in word_blocks(b.column(1)):
                base = base_statistics(w)
                failed = base_failed(base)
                kept = cascade(w, base, ~failed, rules)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *[pa.array(base[k], pa.int64()) for k in BASE], pa.array(failed), pa.array(kept)], ["doc_id", *BASE, "base_failed", "kept"])

    return run


def apply_rules(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judge every whole text; returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    rules may hold rules of one's own; they travel to the executors as they are.  Null text is empty; an empty text fails the base test.  Repeated rows get equal verdicts, null
    ids stay, an empty table gives an empty table, and other columns are ignored, whatever their
    names.  Text is read once, in blocks; nothing is shuffled.
    """
    text = text_of(docs, text_col).alias("text")
    order = order_rules(docs.select(text), rules, sample_rows)
    fields = ", ".join(f"{k} bigint" for k in BASE)
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), text).mapInArrow(_judge(order), f"doc_id bigint, {fields}, base_failed boolean, kept boolean")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT r, unnest(w) AS v, unnest(range(len(w))) AS p FROM d),
g AS (SELECT r, p, v, lag(v) OVER o AS b, lead(v, 1) OVER o AS n1, lead(v, 2) OVER o AS n2 FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
t AS (SELECT r, p, count(*) OVER (PARTITION BY r, v, n1, n2) AS c FROM g WHERE n2 IS NOT NULL),
c AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM t WHERE c > 1) GROUP BY r),
a AS (SELECT r, count(*) FILTER (WHERE v = b) AS adj, count(DISTINCT v) AS dist FROM g GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
s AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             coalesce(n_lines, 0) AS n_lines, coalesce(adj, 0) AS adj, coalesce(dist, 0) AS dist,
             length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS up, length(regexp_replace(text, '[^0-9]+', '', 'g')) AS dig
      FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN a ON a.r = d.r LEFT JOIN l ON l.r = d.r),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 2 * n_dup_lines > n_lines
            OR 2 * up > word_chars OR 10 * dig > 3 * word_chars OR 5 * adj > n_words OR 50 * dist < n_words) AS kept
FROM f
"""
