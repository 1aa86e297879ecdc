"""Segmentation: walk the rows of a key in order and cut where a predicate over the segment's state holds.

Rows stream through sorted partitions with one state at a time, so a group may have any length.  A hard cut that
needs no state (a pause) is made first by a window, so that one long media item spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.distance import similar
from ..functions.text import to_breaks, wrap
from ..plans.settings import PhraseLimits
from ._groups import stream_parts


def pause_islands(cues: DataFrame, pause_ms: int, key: str = "media_id", order: str = "seq") -> DataFrame:
    """cues with island: numbered from 1, a new one when a cue starts pause_ms or more after the end of the one before."""
    w = W.partitionBy(key).orderBy(order)
    cut = (F.col("start_ms") - F.lag("end_ms").over(w) >= pause_ms).cast("int")
    return cues.withColumn("island", 1 + F.sum(F.coalesce(cut, F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))


def phrases(words: DataFrame, limits: PhraseLimits = PhraseLimits(), key: str = "media_id") -> DataFrame:
    """Merge word cues (key, seq, start_ms, end_ms, text) into phrases.

    A phrase ends before a word after a pause, or that would make it too long in time or characters;
    its first word always stays.  Returns key, phrase (from 1), start_ms, end_ms (of the last word),
    n_words, plain_text (wrapped) and raw_text (with break marks)."""
    sep, most_chars, most_ms = len(limits.separator), limits.most_chars, limits.most_ms
    rows = pause_islands(words, limits.pause_ms, key).select(key, "island", "seq", "start_ms", "end_ms", "text")
    size = lambda r: len(r[5] or "")
    got = stream_parts(
        rows, [key, "island"], ["seq"],
        first=lambda r: (r[3], size(r)),
        step=lambda s, r: (s[0], s[1] + sep + size(r)),
        cut=lambda s, r: s[1] + sep + size(r) > most_chars or r[4] - s[0] > most_ms,
    )
    seg = got.groupBy(key, "island", "part").agg(
        F.min_by("start_ms", "seq").alias("start_ms"),
        F.max_by("end_ms", "seq").alias("end_ms"),
        F.count("*").alias("n_words"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), limits.separator).alias("joined"),
    )
    number = F.row_number().over(W.partitionBy(key).orderBy("island", "part")).cast("bigint")
    plain = wrap(F.col("joined"), limits.line_chars, limits.separator)
    return seg.select(key, number.alias("phrase"), "start_ms", "end_ms", "n_words", plain.alias("plain_text"), to_breaks(plain).alias("raw_text"))


def collapse_similar(rows: DataFrame, below: float = 0.2, key: str = "media_id", order: str = "seq", text: str = "text") -> DataFrame:
    """rows with anchor_seq and anchor_text: a text whose edit distance to the last anchor is below the threshold takes it over."""
    got = stream_parts(
        rows.select(key, order, F.col(text).alias("text")), [key], [order],
        first=lambda r: r[2] or "",
        step=lambda s, r: s,
        cut=lambda s, r: not similar(s, r[2] or "", below),
    )
    head = F.first(F.struct(order, "text")).over(W.partitionBy(key, "part").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return got.withColumn("_h", head).select(key, order, "text", F.col(f"_h.{order}").alias("anchor_seq"), F.col("_h.text").alias("anchor_text"))


def pack_batches(items: DataFrame, most_items: int = 200, most_chars: int = 200_000, key: str = "media_id", order: str = "seq", cost: str = "cost") -> DataFrame:
    """items (key, order, cost) with batch (from 0): a batch is closed when it is full, or when the next item would make it too large."""
    got = stream_parts(
        items.select(key, order, cost), [key], [order],
        first=lambda r: (1, r[2]),
        step=lambda s, r: (s[0] + 1, s[1] + r[2]),
        cut=lambda s, r: s[0] >= most_items or s[1] + r[2] > most_chars,
    )
    return got.withColumnRenamed("part", "batch")


def fixed_batches(items: DataFrame, size: int = 50, index: str = "seq") -> DataFrame:
    """items with batch: strides of size along an index that counts from 0."""
    return items.withColumn("batch", F.floor(F.col(index) / size).cast("bigint"))


def request_cost(text: Column, before: Column, after: Column, limit: int = 4000) -> Column:
    return F.least(F.length(text), F.lit(limit)) + F.length(F.array_join(before, "\n")) + F.length(F.array_join(after, "\n")) + 128


def chunk_lines(text: Column, size: int = 30) -> Column:
    """Pack the lines of a text into chunks of at most size characters; an overlong line is cut hard."""
    lines = F.split(F.replace(text, F.lit("\\N"), F.lit("\n")), "\n", -1)
    cut = lambda line: F.transform(F.sequence(F.lit(0), F.greatest(F.length(line) - 1, F.lit(0)), F.lit(size)), lambda i: F.substring(line, i + 1, F.lit(size)))
    zero = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def merge(acc, line):
        now = acc["now"]
        joined = F.when(now == "", line).otherwise(F.concat(now, F.lit("\n"), line))
        flushed = F.when(now == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(now)))
        return (
            F.when(F.length(joined) <= size, F.struct(joined.alias("now"), acc["out"].alias("out")))
            .when(F.length(line) <= size, F.struct(line.alias("now"), flushed.alias("out")))
            .otherwise(F.struct(F.lit("").alias("now"), F.concat(flushed, cut(line)).alias("out")))
        )

    return F.aggregate(lines, zero, merge, lambda acc: F.when(acc["now"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["now"]))))
