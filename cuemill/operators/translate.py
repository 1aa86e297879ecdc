"""Translation of cues: distinct texts with context go to a provider, results come back by lookup."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import from_breaks, to_breaks, trim_all, unix_newlines

#: A callable on texts and their contexts; it may have id, display_name, validate() and estimate(texts) as well.
Provider = Callable[[list[str], list[list[str]], list[list[str]]], list[str]]
_providers: dict[str, Provider] = {"identity": lambda texts, before, after: texts, "mock": lambda texts, before, after: [t.upper() for t in texts]}


def register(name: str, provider: Provider) -> None:
    _providers[name] = provider


def names() -> list[str]:
    return sorted(_providers)


def provider(name: str) -> Provider:
    if name not in _providers:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(names())}")
    return _providers[name]


def first_distinct(cues: DataFrame, key: str = "media_id", order: str = "seq", text: str = "text") -> DataFrame:
    """First row of each trimmed, non-empty text of a key, with text_key."""
    rows = cues.withColumn("text_key", trim_all(F.col(text))).where("text_key <> ''")
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key, "text_key").orderBy(order))).where("_n = 1").drop("_n")


def with_context(cues: DataFrame, reach: int = 2, key: str = "media_id", order: str = "seq", text: str = "text") -> DataFrame:
    """cues with context_before and context_after: the trimmed, non-empty texts of up to reach rows on either side."""
    w = W.partitionBy(key).orderBy(order)
    t = F.nullif(trim_all(F.col(text)), F.lit(""))
    return cues.withColumn("context_before", F.collect_list(t).over(w.rowsBetween(-reach, -1))).withColumn("context_after", F.collect_list(t).over(w.rowsBetween(1, reach)))


def retry_halves(call: Provider, texts: list[str], before: list, after: list, depth: int = 3) -> list[str]:
    """Call a provider; when a batch fails or comes back with another length, its halves are tried, depth times."""
    try:
        out = call(texts, before, after)
        if len(out) == len(texts):
            return out
        raise ValueError(f"{len(out)} texts for {len(texts)}")
    except ValueError:  # of which ProviderError is one; other errors are not mended by smaller batches
        if len(texts) < 2 or depth <= 0:
            raise
    m = len(texts) // 2
    return retry_halves(call, texts[:m], before[:m], after[:m], depth - 1) + retry_halves(call, texts[m:], before[m:], after[m:], depth - 1)


def _call(call: Provider, batch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                yield part[["media_id", "text_key", "line_no"]].assign(line=retry_halves(call, list(part["line"]), [list(x) for x in part["context_before"]], [list(x) for x in part["context_after"]]))

    return run


def check_ids(requests: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """replies to requests, with problem: why a reply cannot be placed (unknown or repeated id) or a request has none; null if all is well."""
    asked = requests.select(*keys).distinct().withColumn("_asked", F.lit(True))
    told = replies.withColumn("_times", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    met = told.join(asked, keys, "full")
    problem = F.when(F.col("_asked").isNull(), "unknown id").when(F.col("_times").isNull(), "no reply").when(F.col("_times") > 1, "repeated id")
    return met.withColumn("problem", problem).drop("_asked", "_times")


def counts(cues: DataFrame, key: str = "media_id", text: str = "text") -> DataFrame:
    """Cues, distinct texts that need a translation, and their lines, by key."""
    t = F.nullif(trim_all(F.col(text)), F.lit(""))
    n_lines = F.size(F.split(unix_newlines(from_breaks(t)), "\n", -1))
    one = cues.select(key, t.alias("t"), n_lines.alias("n")).groupBy(key, "t").agg(F.count("*").alias("cues"), F.first("n").alias("n"))
    unique = F.count("t").alias("unique_texts")
    return one.groupBy(key).agg(F.sum("cues").alias("cues"), unique, F.coalesce(F.sum(F.when(F.col("t").isNotNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("lines"))


def translate(cues: DataFrame, name: str, batch: int = 200, reach: int = 2) -> DataFrame:
    """cues (media_id, seq, text) with translated: each distinct text is translated line by line with its context.

    name is that of a registered provider; it is looked up and validated here, and sent to the executors whole.
    A text without translation keeps itself."""
    call = provider(name)
    getattr(call, "validate", lambda: None)()
    rows = first_distinct(with_context(cues, reach))
    lines = rows.select("media_id", "text_key", "context_before", "context_after", F.posexplode(F.split(unix_newlines(from_breaks(F.col("text_key"))), "\n", -1)).alias("line_no", "line"))
    done = lines.mapInPandas(_call(call, batch), "media_id bigint, text_key string, line_no int, line string")
    joined = done.groupBy("media_id", "text_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("got"))
    joined = joined.select(F.col("media_id").alias("t_media"), F.col("text_key").alias("t_key"), "got")
    out = cues.join(joined, (F.col("media_id") == F.col("t_media")) & (trim_all(F.col("text")) == F.col("t_key")), "left")
    return out.withColumn("translated", F.coalesce(F.nullif("got", F.lit("")), F.col("text"))).withColumn("raw_translated", to_breaks(F.col("translated"))).drop("t_media", "t_key", "got")
