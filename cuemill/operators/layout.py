"""Timelines: union and sort, overlap joins, lanes, display text, ASS documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import to_breaks
from ._groups import stream_groups

OVERLAY, DIALOGUE = "TopOCR", "BottomDialogue"


def timeline(dialogue: DataFrame, overlay: DataFrame, key: str = "media_id") -> DataFrame:
    """Both cue tables in order of start; ties keep dialogue first, then their own order.  number runs from 1."""
    both = dialogue.withColumn("rank", F.lit(0)).unionByName(overlay.withColumn("rank", F.lit(1)))
    return both.withColumn("number", F.row_number().over(W.partitionBy(key).orderBy("start_ms", "rank", "seq")).cast("bigint"))


def merged(dialogue: DataFrame, overlay: DataFrame, key: str = "media_id") -> DataFrame:
    """The merged timeline, numbered anew; it is computed on every run, as it costs less than a look at its parts."""
    return timeline(dialogue, overlay, key).drop("rank")


def overlapping(left: DataFrame, right: DataFrame, key: str = "media_id", bucket_ms: int | None = None) -> DataFrame:
    """Rows of left that any row of right of the same key overlaps: half-open, strict.

    With bucket_ms both sides are spread over time buckets, so that a long or hot media item is no
    single join key; a row of left may meet itself in several buckets and is kept once by (key, seq)."""
    r = right.select(F.col(key).alias("r_key"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    meets = (F.col(key) == F.col("r_key")) & (F.col("start_ms") < F.col("r_end")) & (F.col("r_start") < F.col("end_ms"))
    if bucket_ms is None:
        return left.join(r, meets, "left_semi")
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket_ms), F.floor(F.greatest(F.col(a), F.col(b) - 1) / bucket_ms)))
    spread = left.withColumn("bucket", span("start_ms", "end_ms"))
    r = r.withColumn("r_bucket", span("r_start", "r_end"))
    return spread.join(r, meets & (F.col("bucket") == F.col("r_bucket")), "left_semi").drop("bucket").dropDuplicates([key, "seq"])


def lanes_of(rows: list[tuple]) -> list[tuple]:
    """Lanes of the cues (media_id, island, seq, start_ms, end_ms, y) of an island in order."""
    ends: list[int] = []
    out = []
    for media, _, seq, start, end, _ in rows:
        lane = next((k for k, e in enumerate(ends) if e <= start), len(ends))
        if lane == len(ends):
            ends.append(end)
        else:
            ends[lane] = max(ends[lane], end)
        out.append((media, seq, lane))
    return out


def assign_lanes(cues: DataFrame) -> DataFrame:
    """(media_id, seq, lane): in order of start, y and seq the lowest lane that nothing overlapping holds.

    Cues are first parted into islands that no overlap crosses, which bounds a group."""
    w = W.partitionBy("media_id").orderBy("start_ms", "y", "seq")
    reach = F.max("end_ms").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = cues.select("media_id", "seq", "start_ms", "end_ms", "y").withColumn("cut", F.coalesce((F.col("start_ms") >= reach).cast("int"), F.lit(0)))
    rows = rows.withColumn("island", F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.select("media_id", "island", "seq", "start_ms", "end_ms", "y")
    return stream_groups(rows, ["media_id", "island"], ["start_ms", "y", "seq"], lanes_of, "media_id bigint, seq bigint, lane bigint")


def floors(cues: DataFrame) -> DataFrame:
    """(media_id, seq, lane, floor) of the low overlay cues (y below the second lane's floor) that overlap dialogue."""
    style = G.attribute(F.col("attributes"), "Style")
    overlay = cues.where((style == OVERLAY) & (F.col("y") < G.FLOOR + G.LANE_STEP))
    met = overlapping(overlay, cues.where(style == DIALOGUE))
    return assign_lanes(met).withColumn("floor", G.lane_floor(F.col("lane")))


def place(cues: DataFrame, width: int, height: int, positions: bool = True, rtl: bool = False, sizes: bool = False) -> DataFrame:
    """cues (media_id, seq, start_ms, end_ms, raw_text, attributes, x, y, font_height) with display_text.

    Overlay cues get a position tag unless they have one; those that would cover dialogue are lifted
    into lanes above it."""
    if not positions:
        return cues.withColumn("display_text", F.col("raw_text"))
    low = floors(cues).select(F.col("media_id").alias("f_media"), F.col("seq").alias("f_seq"), "floor")
    rows = cues.join(low, (F.col("media_id") == F.col("f_media")) & (F.col("seq") == F.col("f_seq")), "left")
    size = F.when(F.col("font_height").isNotNull(), G.font_size(F.col("font_height"), height)) if sizes else None
    tag = G.override_prefix(F.col("x"), F.col("y"), width, height, rtl, size, F.col("floor"))
    tagged = (G.attribute(F.col("attributes"), "Style") == OVERLAY) & tag.isNotNull() & ~F.contains("raw_text", F.lit("\\pos("))
    return rows.withColumn("display_text", F.when(F.coalesce(tagged, F.lit(False)), F.concat(tag, F.col("raw_text"))).otherwise(F.col("raw_text"))).drop("f_media", "f_seq", "floor")


# Fixed values of the document format.
ASS_HEAD = "[Script Info]\nScriptType: v4.00+\nPlayResX: {w}\nPlayResY: {h}\n\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\nStyle: TopOCR,Arial,48,&H00FFFFFF,&H000000FF,&H00000000,&H64000000,0,0,0,0,100,100,0,0,1,2,1,8,40,40,40,1\nStyle: BottomDialogue,Arial,54,&H00FFFFFF,&H000000FF,&H00000000,&H64000000,0,0,0,0,100,100,0,0,1,2,1,2,40,40,40,1\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


def with_play_size(document, width: int, height: int):
    """A document's text with the size of the screen named after its script type; as it is if it names one, or no script type."""
    anchor = "ScriptType: v4.00+"
    head = F.substring_index(document, anchor, 1)
    rest = F.substr(document, F.length(head) + len(anchor) + 1)
    added = F.concat(head, F.lit(f"{anchor}\nPlayResX: {width}\nPlayResY: {height}\n"), rest)
    return F.when(F.contains(document, F.lit("PlayResX:")) | ~F.contains(document, F.lit(anchor)), document).otherwise(added)


def ass_time(ms):
    part = lambda unit, size, width: F.lpad(F.floor(ms / unit % size).cast("string"), width, "0")
    return F.concat(F.floor(ms / 3_600_000).cast("string"), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit("."), part(10, 100, 2))


def ass_lines(placed: DataFrame, width: int = G.PLAY_WIDTH, height: int = G.PLAY_HEIGHT) -> DataFrame:
    """(media_id, line_no, line): the document of each media item, head first, cues by number."""
    style = F.coalesce(G.attribute(F.col("attributes"), "Style"), F.lit(DIALOGUE))
    number = F.row_number().over(W.partitionBy("media_id").orderBy("start_ms", "seq")).cast("bigint")
    cue = F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start_ms")), F.lit(","), ass_time(F.col("end_ms")), F.lit(","), style, F.lit(",,0,0,0,,"), to_breaks(F.col("display_text")))
    lines = placed.select("media_id", number.alias("line_no"), cue.alias("line"))
    heads = placed.select("media_id").distinct().select("media_id", F.lit(0).cast("bigint").alias("line_no"), F.lit(ASS_HEAD.format(w=width, h=height)).alias("line"))
    return heads.unionByName(lines)
