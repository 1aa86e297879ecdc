"""Structured Streaming: resumable frame ingestion, and pause segmentation over micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import let, trim_blanks
from ..sources.store import contiguous_prefix


def ingest_frames(frames: DataFrame, path: str, checkpoint: str, process=None):
    """Append frame records batch by batch as JSON; a restart resumes at the checkpoint.

    process, if given, maps each batch before it is written."""

    def write(batch: DataFrame, _: int) -> None:
        (process(batch) if process else batch).write.mode("append").json(path)

    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pause_segments(words: DataFrame, pause_ms: int) -> DataFrame:
    """Streamed words (media_id, seq, start_ms, end_ms) with segment: the state of a key is its last end and number."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        end, number = state.get if state.exists else (None, 1)
        pdf = pd.concat(list(frames)).sort_values("seq")
        out = []
        for r in pdf.itertuples():
            if end is not None and r.start_ms - end >= pause_ms:
                number += 1
            end = int(r.end_ms)
            out.append((key[0], r.seq, number))
        state.update((end, number))
        yield pd.DataFrame(out, columns=["media_id", "seq", "segment"])

    return words.groupBy("media_id").applyInPandasWithState(step, "media_id bigint, seq bigint, segment bigint", "last_end bigint, number bigint", "append", GroupStateTimeout.NoTimeout)


def word_cues(results: DataFrame) -> DataFrame:
    """Word cues of recognition results (media_id, result, text, runs of text, start_s, duration_s).

    Runs without text are left out; a result that has no cue of its runs gives one cue of a second with its
    whole text, unless that is blank."""

    def cue(r):
        end = ((r["start_s"] + r["duration_s"]) * 1000).cast("bigint")
        return F.struct(trim_blanks(r["text"]).alias("text"), (r["start_s"] * 1000).cast("bigint").alias("start_ms"), end.alias("end_ms"))

    timed = F.filter(F.transform(F.filter("runs", lambda r: r["start_s"].isNotNull()), cue), lambda c: c["text"] != "")
    whole = F.array(F.struct(trim_blanks(F.col("text")).alias("text"), F.lit(0).cast("bigint").alias("start_ms"), F.lit(1000).cast("bigint").alias("end_ms")))
    cues = let(timed, lambda got: F.when(F.size(got) > 0, got).otherwise(whole))
    return results.select("media_id", "result", F.posexplode(cues).alias("n", "c")).select("media_id", "result", "n", "c.*").where("text <> ''")


def end_seconds(runs):
    """Largest end of timed runs, 0 without any."""
    ends = F.transform(F.filter(runs, lambda r: r["start_s"].isNotNull()), lambda r: r["start_s"] + r["duration_s"])
    return F.greatest(F.coalesce(F.array_max(ends), F.lit(0.0)), F.lit(0.0))


def resume_point(records: DataFrame, key: str = "media_id") -> DataFrame:
    """Where the scan of each medium goes on: next_index, and the last fingerprint and observations to compare and carry."""
    kept = contiguous_prefix(records, key)
    last = F.max_by(F.struct("fingerprint", "observations"), "index").alias("last")
    return kept.groupBy(key).agg((F.max("index") + 1).alias("next_index"), last).select(key, "next_index", "last.*")


def remaining(grid: DataFrame, records: DataFrame, key: str = "media_id") -> DataFrame:
    """The frames of a sampling grid that records do not cover yet."""
    points = resume_point(records, key).select(F.col(key).alias("r_key"), "next_index")
    met = grid.join(points, F.col(key) == F.col("r_key"), "left")
    return met.where(F.col("frame") >= F.coalesce("next_index", F.lit(0))).drop("r_key", "next_index")


def progress(frames: DataFrame, total: int, name: str = "frames"):
    """frames with an Observation of the rows that pass, and a function that tells it, clamped to total."""
    seen = Observation(name)
    return frames.observe(seen, F.count(F.lit(1)).alias("done")), lambda: f"{min(seen.get['done'], total)}/{total}"
