"""Frames of a video: sampling grid, similarity skips, runs of equal text, tracking of positioned text."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.distance import similar
from ..plans.settings import FrameProfile
from ._groups import stream_groups


def frame_grid(media: DataFrame, fps: float, key: str = "media_id") -> DataFrame:
    """(key, frame, sample_s) of the samples of each media item with duration_s; at least one."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration_s") * fps)).cast("bigint")
    return media.select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("frame")).withColumn("sample_s", F.col("frame") / F.lit(float(fps)))


def merge_runs(frames: DataFrame, key: str = "media_id", frame: str = "frame", text: str = "text") -> DataFrame:
    """Runs of equal text on consecutive frames: key, run (from 1), first_frame, end_frame (exclusive), text."""
    w = W.partitionBy(key).orderBy(frame)
    cut = (F.lag(text).over(w) != F.col(text)) | (F.lag(frame).over(w) != F.col(frame) - 1)
    rows = frames.withColumn("run", 1 + F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(key, "run").agg(F.min(frame).alias("first_frame"), (F.max(frame) + 1).alias("end_frame"), F.first(text).alias("text"))


def frame_ms(frame: Column, fps: float) -> Column:
    return ((frame / F.lit(float(fps))) * 1000).cast("bigint")


def fingerprint_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two byte arrays over 255, as float; 1 if they differ in length or are empty."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda acc, x: acc + x)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), F.lit(1.0).cast("float")).otherwise((total / (F.size(a) * F.lit(255.0))).cast("float"))


def similar_to_previous(frames: DataFrame, below: float = 0.03, key: str = "media_id", frame: str = "frame", fingerprint: str = "fingerprint") -> DataFrame:
    """frames with difference (to the frame before) and reused (below the threshold)."""
    before = F.lag(fingerprint).over(W.partitionBy(key).orderBy(frame))
    out = frames.withColumn("difference", F.when(before.isNotNull() & F.col(fingerprint).isNotNull(), fingerprint_difference(before, F.col(fingerprint))))
    return out.withColumn("reused", F.coalesce(F.col("difference") < F.lit(below).cast("float"), F.lit(False)))


def fill_reused(frames: DataFrame, value: str, key: str = "media_id", frame: str = "frame", reused: str = "reused") -> DataFrame:
    """frames with filled: a reused frame takes the last recognized value before it."""
    w = W.partitionBy(key).orderBy(frame).rowsBetween(W.unboundedPreceding, 0)
    return frames.withColumn("filled", F.last(F.when(~F.col(reused), F.col(value)), ignorenulls=True).over(w))


def join_texts(observations: DataFrame, key: str = "media_id", frame: str = "frame", order: str = "seq", text: str = "text") -> DataFrame:
    """One text a frame: its texts in order, joined by break marks."""
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return observations.groupBy(key, frame).agg(F.array_join(F.transform(rows, lambda x: x[text]), "\\N").alias("text")).where("text <> ''")


def keep_observations(observations: DataFrame, screen_height: float, p: FrameProfile) -> DataFrame:
    """Observations (text, x, y, w, h and, if known, skew) that a profile keeps; all of them if it filters nothing."""
    if not p.filter_regions:
        return observations
    x, y, w, h = (F.col(c) for c in "xywh")
    keep = G.tall_enough(h, screen_height, p) & G.wide_enough(w, h) & ~G.in_excluded_region(x + w / 2, y + h / 2, p)
    if "skew" in observations.columns:
        keep = keep & G.straight(F.col("skew"), p.most_skew)
    return observations.where(keep)


def positioned_texts(observations: DataFrame, screen_height: float, p: FrameProfile, rtl: bool = False) -> DataFrame:
    """One row an observation kept: media_id, frame, text as displayed, its anchor (x, y) and font_height."""
    kept = keep_observations(observations, screen_height, p)
    x, y, w, h = (F.col(c) for c in "xywh")
    anchor_x, anchor_y = G.anchor(x, x + w, y, y + h, rtl)
    text = G.display_text(F.col("text"), w, h, p)
    return kept.select("media_id", "frame", text.alias("text"), anchor_x.alias("x"), anchor_y.alias("y"), G.font_height(h).alias("font_height"))


def frame_texts(observations: DataFrame, screen_height: float, p: FrameProfile, positioned: bool = False, rtl: bool = False, order: str = "seq") -> DataFrame:
    """Texts of frames: one an observation with its place, or one a frame, joined and without place.

    Raw observations are what is stored; this is applied when they are read, so that a changed profile needs no new recognition."""
    if positioned:
        return positioned_texts(observations, screen_height, p, rtl)
    kept = keep_observations(observations, screen_height, p)
    shown = kept.select("media_id", "frame", order, G.display_text(F.col("text"), F.col("w"), F.col("h"), p).alias("text"))
    none = F.lit(None).cast("double")
    return join_texts(shown, order=order).select("media_id", "frame", "text", none.alias("x"), none.alias("y"), none.alias("font_height"))


def rederive(records: DataFrame, frame_count: int, screen_height: float, p: FrameProfile, positioned: bool = False) -> DataFrame:
    """Frame texts of stored records (media_id, index, observations) below frame_count, by the profile of today."""
    rows = records.where(F.col("index") < frame_count).select("media_id", F.col("index").alias("frame"), F.posexplode("observations").alias("seq", "o"))
    return frame_texts(rows.select("media_id", "frame", "seq", "o.*"), screen_height, p, positioned)


TRACK_SCHEMA = "media_id bigint, first_frame bigint, end_frame bigint, born bigint, text string, x double, y double"


def _gap(t, x, y) -> float | None:
    """Distance of a track and an item, None if not near; two without position are near."""
    here, there = t["x"] is not None, x is not None
    if here != there:
        return None
    d = ((t["x"] - x) ** 2 + (t["y"] - y) ** 2) ** 0.5 if here else 0.0
    return d if d <= 0.05 else None


def track_island(rows: list[tuple], below: float = 0.2) -> list[tuple]:
    """Tracks of one run of consecutive frames with items; rows are (media_id, island, frame, text, x, y) by frame."""
    open_tracks, done, born = [], [], 0
    for frame, items in groupby(rows, key=lambda r: r[2]):
        taken: set[int] = set()
        seen = [(x if y is not None else None, y if x is not None else None, text or "") for _, _, _, text, x, y in items]
        seen.sort(key=lambda r: (True, 0.0, 0.0, r[2]) if r[0] is None else (False, -r[1], r[0], ""))
        for x, y, text in seen:
            best = None
            for k, t in enumerate(open_tracks):
                if k in taken or t["end"] != frame:
                    continue
                gap = _gap(t, x, y)
                if gap is not None and (best is None or gap < best[0]) and similar(t["text"], text, below):
                    best = (gap, k)
            if best:
                open_tracks[best[1]]["end"] = frame + 1
                taken.add(best[1])
            else:
                taken.add(len(open_tracks))
                open_tracks.append({"first": frame, "end": frame + 1, "born": born, "text": text, "x": x, "y": y})
                born += 1
        done += [t for t in open_tracks if t["end"] <= frame]
        open_tracks = [t for t in open_tracks if t["end"] > frame]
    return [(rows[0][0], t["first"], t["end"], t["born"], t["text"], t["x"], t["y"]) for t in done + open_tracks]


def track(items: DataFrame, below: float = 0.2) -> DataFrame:
    """Track positioned texts (media_id, frame, text, x, y) over frames.

    Frames fall into islands of consecutive frames with items, tracked independently; items of a frame
    at one position go by text; results are numbered by (first_frame, end_frame) and creation."""
    frames = items.select("media_id", "frame").distinct()
    w = W.partitionBy("media_id").orderBy("frame")
    frames = frames.withColumn("island", F.sum(F.coalesce((F.lag("frame").over(w) != F.col("frame") - 1).cast("int"), F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = items.join(frames, ["media_id", "frame"]).select("media_id", "island", "frame", "text", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    tracks = stream_groups(rows, ["media_id", "island"], ["frame", "text"], lambda got: track_island(got, below), TRACK_SCHEMA)
    number = F.row_number().over(W.partitionBy("media_id").orderBy("first_frame", "end_frame", "born")).cast("bigint")
    return tracks.withColumn("track", number).drop("born")
