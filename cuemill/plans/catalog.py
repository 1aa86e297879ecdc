"""One query per operator over the driver's tables, and the SQL that must give the same rows.

The tables are no cues, so each query first projects them: events are words or cues of the medium
user_id, document lines are frames, line items are text boxes, embeddings are fingerprints."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import messages as M
from ..functions import text as T
from ..operators import frames, layout, providers, segment, translate
from ..sources.store import contiguous_prefix, from_iso, to_iso
from ..streaming import incremental
from .settings import PhraseLimits, profile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LIMITS = PhraseLimits(pause_ms=43_200_000, most_ms=172_800_000, most_chars=40, line_chars=20)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _start():
    return F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as word cues: the medium is the user, a word lasts value seconds."""
    e = _read(spark, sf_dir, "events")
    order = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    return e.select(F.col("user_id").alias("media_id"), order.alias("seq"), _start().alias("start_ms"), (_start() + (F.col("value") * 1000).cast("bigint")).alias("end_ms"), F.col("event_type").alias("text"), "event_id")


WORDS = """words AS (SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, epoch_us(ts) // 1000 AS start_ms,
  epoch_us(ts) // 1000 + CAST(trunc(value * 1000) AS BIGINT) AS end_ms, event_type AS text, event_id FROM events)"""


def cues(spark: SparkSession, sf_dir: str, kind: str, k: int = 600_000) -> DataFrame:
    """Events of one type as cues of the user that last value times k milliseconds."""
    e = _read(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select(F.col("user_id").alias("media_id"), F.col("event_id").alias("seq"), _start().alias("start_ms"), (_start() + (F.col("value") * k).cast("bigint")).alias("end_ms"), (F.pmod("event_id", F.lit(19)) / F.lit(100.0)).alias("y"))


def _cues_sql(kind: str, k: int = 600_000) -> str:
    return f"SELECT user_id AS media_id, event_id AS seq, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(trunc(value * {k}) AS BIGINT) AS end_ms, (event_id % 19) / 100.0::DOUBLE AS y FROM events WHERE event_type = '{kind}'"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as frames of the medium doc_id."""
    d = _read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("media_id"), F.posexplode(F.split("text", "\n", -1)).alias("p", "text")).select("media_id", F.col("p").cast("bigint").alias("frame"), "text")


LINES = "lines AS (SELECT doc_id AS media_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS frame FROM documents)"

BOX = "l_orderkey AS media_id, l_linenumber AS frame, l_partkey, l_suppkey, l_quantity / 50 AS x, l_discount * 10 AS y, l_tax * 2 AS w, l_tax + 0.01::DOUBLE AS h"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as text boxes."""
    li = _read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("media_id"), F.col("l_linenumber").cast("bigint").alias("frame"), "l_partkey", "l_suppkey", (F.col("l_quantity") / 50).alias("x"), (F.col("l_discount") * 10).alias("y"), (F.col("l_tax") * 2).alias("w"), (F.col("l_tax") + 0.01).alias("h"))


BOXES = f"boxes AS (SELECT {BOX} FROM lineitem)"


@query(f"""
WITH RECURSIVE {WORDS},
f AS (
  SELECT media_id, seq, start_ms, end_ms, text, start_ms AS s0, length(text) AS n, 1 AS seg FROM words WHERE seq = 1
  UNION ALL
  SELECT w.media_id, w.seq, w.start_ms, w.end_ms, w.text,
         CASE WHEN cut THEN w.start_ms ELSE s0 END, CASE WHEN cut THEN length(w.text) ELSE n + 1 + length(w.text) END, CASE WHEN cut THEN seg + 1 ELSE seg END
  FROM (SELECT f.s0, f.n, f.seg, w.*, w.start_ms - f.end_ms >= 43200000 OR f.n + 1 + length(w.text) > 40 OR w.end_ms - f.s0 > 172800000 AS cut
        FROM f JOIN words w ON w.media_id = f.media_id AND w.seq = f.seq + 1) w)
SELECT media_id, CAST(seg AS BIGINT) AS phrase, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms, count(*) AS n_words,
       replace(string_agg(text, ' ' ORDER BY seq), ' ', '_') AS words
FROM f GROUP BY media_id, seg
""")
def phrase_segments(spark, sf_dir):
    got = segment.phrases(words(spark, sf_dir), LIMITS)
    return got.select("media_id", "phrase", "start_ms", "end_ms", "n_words", F.translate("plain_text", " \n", "__").alias("words"))


@query(f"""
WITH {WORDS}, g AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w >= 43200000 THEN 1 ELSE 0 END AS cut FROM words WINDOW w AS (PARTITION BY media_id ORDER BY seq))
SELECT media_id, seq, CAST(1 + sum(cut) OVER (PARTITION BY media_id ORDER BY seq) AS BIGINT) AS island FROM g
""")
def pause_islands(spark, sf_dir):
    return segment.pause_islands(words(spark, sf_dir), LIMITS.pause_ms).select("media_id", "seq", F.col("island").cast("bigint").alias("island"))


@query(f"""
WITH {LINES}, g AS (SELECT *, frame - row_number() OVER (PARTITION BY media_id, text ORDER BY frame) AS k FROM lines),
r AS (SELECT media_id, text, min(frame) AS a, max(frame) + 1 AS b FROM g GROUP BY media_id, text, k)
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY a) AS run, CAST(trunc(a / 3.0::DOUBLE * 1000) AS BIGINT) AS start_ms,
       CAST(trunc(b / 3.0::DOUBLE * 1000) AS BIGINT) AS end_ms, text FROM r
""")
def frame_runs(spark, sf_dir):
    got = frames.merge_runs(lines(spark, sf_dir))
    return got.select("media_id", F.col("run").cast("bigint").alias("run"), frames.frame_ms(F.col("first_frame"), 3).alias("start_ms"), frames.frame_ms(F.col("end_frame"), 3).alias("end_ms"), "text")


# DuckDB measures edits in bytes, so SQL gives each letter outside ASCII that the tables have a byte that they lack.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
ONE_BYTE = f"translate(text, '{LETTERS}', array_to_string(list_transform(range(1, {len(LETTERS) + 1}), lambda i: chr(CAST([1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25][i] AS INTEGER))), ''))"
RATIO = "CAST(levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) AS FLOAT)"


@query(rf"""
WITH RECURSIVE {LINES}, d AS (SELECT media_id, frame, text, {ONE_BYTE} AS k FROM lines),
f AS (
  SELECT media_id, frame, k, frame AS a, text AS t, k AS ak FROM d WHERE frame = 0
  UNION ALL
  SELECT media_id, frame, k, CASE WHEN near THEN a ELSE frame END, CASE WHEN near THEN t ELSE text END, CASE WHEN near THEN ak ELSE k END
  FROM (SELECT d.media_id, d.frame, d.text, d.k, f.a, f.t, f.ak,
               CASE WHEN d.k = f.ak THEN true WHEN length(d.k) = 0 OR length(f.ak) = 0 THEN false
                    WHEN CAST(abs(length(d.k) - length(f.ak))::DOUBLE / greatest(length(d.k), length(f.ak)) AS FLOAT) >= CAST(0.2 AS FLOAT) THEN false
                    ELSE {RATIO.format(a="f.ak", b="d.k")} < CAST(0.2 AS FLOAT) END AS near
        FROM f JOIN d ON d.media_id = f.media_id AND d.frame = f.frame + 1))
SELECT media_id, CAST(frame AS BIGINT) AS frame, CAST(a AS BIGINT) AS anchor_frame, t AS anchor_text FROM f
""")
def near_dup_collapse(spark, sf_dir):
    """Whole lines of a document, in order."""
    got = segment.collapse_similar(lines(spark, sf_dir), order="frame")
    return got.select("media_id", "frame", F.col("anchor_seq").alias("anchor_frame"), "anchor_text")


@query(rf"""
WITH {LINES}, a AS (SELECT media_id, frame, {ONE_BYTE} AS text FROM lines),
p AS (SELECT media_id, frame, text, lag(text) OVER (PARTITION BY media_id ORDER BY frame) AS before FROM a)
SELECT media_id, CAST(frame AS BIGINT) AS frame, CAST(CASE WHEN text = before THEN 0 WHEN length(text) = 0 OR length(before) = 0 THEN 1
       ELSE {RATIO.format(a="before", b="text")} END AS DOUBLE) AS distance FROM p WHERE before IS NOT NULL
""")
def edit_distance_pairs(spark, sf_dir):
    """Whole lines of a document and the line before."""
    rows = lines(spark, sf_dir).withColumn("before", F.lag("text").over(W.partitionBy("media_id").orderBy("frame"))).where("before is not null")
    return rows.select("media_id", "frame", T.edit_distance(F.col("before"), F.col("text")).cast("double").alias("distance"))


@query(f"""
WITH {BOXES}, c AS (SELECT *, x + w / 2 AS cx, y + h / 2 AS cy FROM boxes)
SELECT media_id, CAST(frame AS BIGINT) AS frame, l_partkey, x, y, w, h FROM c
WHERE NOT ((cx >= 0.2 AND cx < 0.8 AND cy >= 0.85 AND cy < 1.0) OR (cx >= 0 AND cx < 0.2 AND cy >= 0.65 AND cy < 1.0) OR (cx >= 0.8 AND cx < 1.0 AND cy >= 0.65 AND cy < 1.0)
  OR (cx >= 0 AND cx < 1.0 AND cy >= 0 AND cy < 0.1) OR (cx >= 0 AND cx < 0.2 AND cy >= 0 AND cy < 0.15) OR (cx >= 0.8 AND cx < 1.0 AND cy >= 0 AND cy < 0.15))
  AND h * 720 >= CAST(CAST(0.02 AS FLOAT) AS DOUBLE) * 720 AND NOT (w * 1.05 < h)
""")
def region_filter(spark, sf_dir):
    p = profile("default")
    b = boxes(spark, sf_dir)
    keep = ~G.in_excluded_region(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, p) & G.tall_enough(F.col("h"), 720, p) & G.wide_enough(F.col("w"), F.col("h"))
    return b.where(keep).select("media_id", "frame", "l_partkey", "x", "y", "w", "h")


@query(f"""
WITH {BOXES}, s AS (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE degrees(atan2(h - w / 2, 0.5::DOUBLE)) END AS top, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE degrees(atan2(w - h, 0.5::DOUBLE)) END AS bottom FROM boxes)
SELECT media_id, CAST(frame AS BIGINT) AS frame, l_partkey, round(coalesce((top + bottom) / 2, top, bottom), 6) AS skew FROM s WHERE coalesce(abs(coalesce((top + bottom) / 2, top, bottom)) <= 5, true)
""")
def skew_filter(spark, sf_dir):
    zero, half = F.lit(0.0), F.lit(0.5)
    b = boxes(spark, sf_dir)
    top_y = F.when(F.col("l_partkey") % 3 != 0, F.col("h") - F.col("w") / 2)
    bottom_y = F.when(F.col("l_partkey") % 5 != 0, F.col("w") - F.col("h"))
    b = b.withColumn("angle", G.skew_angle(zero, zero, half, top_y, zero, zero, half, bottom_y)).where(G.straight(F.col("angle")))
    return b.select("media_id", "frame", "l_partkey", F.round("angle", 6).alias("skew"))


@query(f"WITH {BOXES} SELECT media_id, CAST(frame AS BIGINT) AS frame, l_partkey, CASE WHEN w * h < 0.0055 THEN '(' || l_partkey || ')' ELSE CAST(l_partkey AS VARCHAR) END AS text FROM boxes")
def paren_text(spark, sf_dir):
    return boxes(spark, sf_dir).select("media_id", "frame", "l_partkey", G.display_text(F.col("l_partkey").cast("string"), F.col("w"), F.col("h"), profile("default")).alias("text"))


@query(f"WITH {BOXES} SELECT media_id, CAST(frame AS BIGINT) AS frame, string_agg(CAST(l_partkey AS VARCHAR), '\\N' ORDER BY l_partkey, l_suppkey) AS text FROM boxes GROUP BY media_id, frame")
def frame_join_text(spark, sf_dir):
    rows = boxes(spark, sf_dir).select("media_id", "frame", F.struct("l_partkey", "l_suppkey").alias("seq"), F.col("l_partkey").cast("string").alias("text"))
    return frames.join_texts(rows)


@query(f"""
WITH {BOXES}, e AS (SELECT media_id, min(x) AS x0, max(x + w) AS x1, min(y) AS y0, max(y + h) AS y1 FROM boxes GROUP BY media_id)
SELECT media_id, least(greatest((x0 + x1) / 2, 0), 1) AS center_x, least(greatest((y0 + y1) / 2, 0), 1) AS center_y, least(greatest(x0, 0), 1) AS ltr_x, least(greatest(x1, 0), 1) AS rtl_x FROM e
""")
def anchor_envelope(spark, sf_dir):
    e = boxes(spark, sf_dir).groupBy("media_id").agg(*G.envelope(*(F.col(c) for c in "xywh")))
    around = [F.col(c) for c in ("x0", "x1", "y0", "y1")]
    (center_x, center_y), (left, _), (right, _) = G.center(*around), G.anchor(*around), G.anchor(*around, rtl=True)
    return e.select("media_id", center_x.alias("center_x"), center_y.alias("center_y"), left.alias("ltr_x"), right.alias("rtl_x"))


@query(f"""
WITH {BOXES} SELECT media_id, CAST(frame AS BIGINT) AS frame, l_partkey,
  '{{\\an4\\fs' || CAST(least(greatest(round(least(greatest(h, 0), 1) * 720 * 0.85::DOUBLE), 34), 64) AS BIGINT) || '\\pos(' || CAST(round(least(greatest(x, 0), 1) * 1280) AS BIGINT) || ',' || CAST(round((1 - least(greatest(y, 0), 1)) * 720) AS BIGINT) || ')}}' AS tag
FROM boxes
""")
def override_prefix(spark, sf_dir):
    tag = G.override_prefix(F.col("x"), F.col("y"), 1280, 720, size=G.font_size(F.col("h"), 720))
    return boxes(spark, sf_dir).select("media_id", "frame", "l_partkey", tag.alias("tag"))


@query(f"""
WITH {BOXES} SELECT media_id, CAST(frame AS BIGINT) AS frame, l_partkey, CAST(least(greatest(round(least(greatest(h, 0), 1) * 1080 * 0.85::DOUBLE), 34), 64) AS BIGINT) AS size,
  round(least(greatest(0.16::DOUBLE + 0.04::DOUBLE * (frame % 5), 0), 1), 6) AS floor FROM boxes
""")
def font_size(spark, sf_dir):
    return boxes(spark, sf_dir).select("media_id", "frame", "l_partkey", G.font_size(F.col("h"), 1080).alias("size"), F.round(G.lane_floor(F.col("frame") % 5), 6).alias("floor"))


@query("""
WITH b AS (SELECT label, vec_id, list_transform(embedding, lambda v: CAST(floor((v::DOUBLE + 1) * 127.5) AS BIGINT)) AS f FROM embeddings),
p AS (SELECT vec_id, f, lag(f) OVER (PARTITION BY label ORDER BY vec_id) AS g FROM b),
d AS (SELECT vec_id, CAST(list_sum(list_transform(list_zip(f, g), lambda z: abs(z[1] - z[2]))) / (len(f) * 255.0::DOUBLE) AS FLOAT) AS x FROM p)
SELECT vec_id AS frame, CAST(x AS DOUBLE) AS difference, coalesce(x < CAST(0.07 AS FLOAT), false) AS reused FROM d
""")
def fingerprint_skip(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    rows = e.select(F.col("label").alias("media_id"), F.col("vec_id").alias("frame"), F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("int")).alias("fingerprint"))
    return frames.similar_to_previous(rows, below=0.07).select("frame", F.col("difference").cast("double").alias("difference"), "reused")


@query(f"""
WITH {WORDS} SELECT media_id, seq, last_value(CASE WHEN event_id % 3 <> 0 THEN text END IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY seq) AS filled FROM words
""")
def reuse_fill(spark, sf_dir):
    rows = words(spark, sf_dir).withColumn("reused", F.col("event_id") % 3 == 0)
    return frames.fill_reused(rows, "text", frame="seq").select("media_id", "seq", "filled")


@query(f"WITH v AS ({_cues_sql('view')}), d AS ({_cues_sql('click')}) SELECT media_id, seq, start_ms, end_ms FROM v WHERE EXISTS (SELECT 1 FROM d WHERE d.media_id = v.media_id AND v.start_ms < d.end_ms AND d.start_ms < v.end_ms)")
def overlap_semi(spark, sf_dir):
    return layout.overlapping(cues(spark, sf_dir, "view"), cues(spark, sf_dir, "click")).select("media_id", "seq", "start_ms", "end_ms")


@query(ORACLES["overlap_semi"])
def overlap_semi_bucketed(spark, sf_dir):
    return layout.overlapping(cues(spark, sf_dir, "view"), cues(spark, sf_dir, "click"), bucket_ms=3_600_000 * 24).select("media_id", "seq", "start_ms", "end_ms")


@query(f"""
WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, y, seq) AS n FROM ({_cues_sql('view', 60_000_000)})),
f AS (
  SELECT media_id, seq, n, 1 AS lane, [end_ms] AS ends FROM c WHERE n = 1
  UNION ALL
  SELECT media_id, seq, n, lane, CASE WHEN lane > len(ends) THEN list_append(ends, end_ms) ELSE list_transform(ends, lambda e, i: CASE WHEN i = lane THEN greatest(e, end_ms) ELSE e END) END
  FROM (SELECT c.media_id, c.seq, c.n, c.end_ms, f.ends, coalesce(list_position(list_transform(f.ends, lambda e: e <= c.start_ms), true), len(f.ends) + 1) AS lane
        FROM f JOIN c ON c.media_id = f.media_id AND c.n = f.n + 1))
SELECT media_id, seq, CAST(lane - 1 AS BIGINT) AS lane FROM f
""")
def lane_assign(spark, sf_dir):
    return layout.assign_lanes(cues(spark, sf_dir, "view", 60_000_000))


@query()
def track_objects(spark, sf_dir):
    b = boxes(spark, sf_dir).select("media_id", "frame", F.col("l_partkey").cast("string").alias("text"), F.round(F.col("x") / 10, 2).alias("x"), F.round(F.col("y") / 10, 2).alias("y"))
    return frames.track(b)


@query(f"""
WITH u AS (SELECT *, 0 AS r FROM ({_cues_sql('click')}) UNION ALL SELECT *, 1 AS r FROM ({_cues_sql('view')}))
SELECT media_id, seq, start_ms, end_ms, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, r, seq) AS number FROM u
""")
def timeline_union(spark, sf_dir):
    return layout.timeline(cues(spark, sf_dir, "click"), cues(spark, sf_dir, "view")).select("media_id", "seq", "start_ms", "end_ms", "number")


def turns(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seq"), "role", "text")


@query(r"""
WITH t AS (SELECT conv_id, turn, nullif(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '') AS t FROM conversations)
SELECT conv_id AS media_id, turn AS seq, coalesce(array_to_string(list(t) FILTER (WHERE t IS NOT NULL) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '|'), '') AS before,
       coalesce(array_to_string(list(t) FILTER (WHERE t IS NOT NULL) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '|'), '') AS after
FROM t
""")
def context_window(spark, sf_dir):
    got = translate.with_context(turns(spark, sf_dir))
    return got.select("media_id", "seq", F.array_join("context_before", "|").alias("before"), F.array_join("context_after", "|").alias("after"))


@query("""
WITH d AS (SELECT lang, doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS k FROM documents)
SELECT lang, doc_id, sha256(k) AS text_key FROM (SELECT *, row_number() OVER (PARTITION BY lang, k ORDER BY doc_id) AS n FROM d WHERE k <> '') WHERE n = 1
""")
def first_distinct(spark, sf_dir):
    got = translate.first_distinct(_read(spark, sf_dir, "documents"), key="lang", order="doc_id")
    return got.select("lang", "doc_id", F.sha2(F.col("text_key").cast("binary"), 256).alias("text_key"))


@query("SELECT conv_id AS media_id, turn AS seq, text AS translated FROM conversations")
def translate_identity(spark, sf_dir):
    return translate.translate(turns(spark, sf_dir), "identity").select("media_id", "seq", T.trim_all(F.col("translated")).alias("translated"))


@query("SELECT conv_id AS media_id, turn AS seq, upper(replace(regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g'), chr(10), '\\N')) AS translated FROM conversations")
def translate_mock(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?"))
    return translate.translate(rows, "mock").select("media_id", "seq", F.col("raw_translated").alias("translated"))


@query("""
WITH RECURSIVE d AS (SELECT lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS seq, CAST(least(n_chars, 4000) + 128 AS BIGINT) AS cost FROM documents),
f AS (
  SELECT lang, source, seq, cost, cost AS s, 1 AS n, 0 AS batch FROM d WHERE seq = 1
  UNION ALL
  SELECT lang, source, seq, cost, CASE WHEN cut THEN cost ELSE s + cost END, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN batch + 1 ELSE batch END
  FROM (SELECT d.*, f.s, f.n, f.batch, f.n >= 12 OR f.s + d.cost > 20000 AS cut FROM f JOIN d ON d.lang = f.lang AND d.source = f.source AND d.seq = f.seq + 1))
SELECT lang, source, seq, cost, CAST(batch AS BIGINT) AS batch FROM f
""")
def batch_pack(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").where("lang is not null and source is not null")
    order = F.row_number().over(W.partitionBy("lang", "source").orderBy("doc_id")).cast("bigint")
    rows = d.select(F.struct("lang", "source").alias("k"), order.alias("seq"), (F.least("n_chars", F.lit(4000)) + 128).cast("bigint").alias("cost"))
    got = segment.pack_batches(rows.select(F.to_json("k").alias("k"), "seq", "cost"), 12, 20_000, key="k")
    at = lambda c: F.get_json_object("k", f"$.{c}").alias(c)
    return got.select(at("lang"), at("source"), "seq", "cost", F.col("batch").cast("bigint").alias("batch"))


CHUNK = """WITH RECURSIVE l AS (SELECT conv_id, turn, string_split(replace(text, '\\N', chr(10)), chr(10)) AS lines FROM conversations),
f AS (
  SELECT conv_id, turn, lines, 0 AS i, '' AS now, CAST([] AS VARCHAR[]) AS out FROM l
  UNION ALL
  SELECT conv_id, turn, lines, i + 1, CASE WHEN length(joined) <= 30 THEN joined WHEN length(line) <= 30 THEN line ELSE '' END,
         CASE WHEN length(joined) <= 30 THEN out WHEN length(line) <= 30 THEN flushed
              ELSE list_concat(flushed, list_transform(range(0, greatest(length(line), 1), 30), lambda k: substr(line, CAST(k AS INTEGER) + 1, 30))) END
  FROM (SELECT *, CASE WHEN now = '' THEN line ELSE now || chr(10) || line END AS joined, CASE WHEN now = '' THEN out ELSE list_append(out, now) END AS flushed
        FROM (SELECT *, lines[i + 1] AS line FROM f WHERE i < len(lines)))),
d AS (SELECT conv_id, turn, CASE WHEN now = '' THEN out ELSE list_append(out, now) END AS out FROM f WHERE i = len(lines))
SELECT conv_id, turn, CAST(unnest(range(len(out))) AS INTEGER) AS chunk, unnest(out) AS text FROM d"""


@query(CHUNK)
def chunk_text(spark, sf_dir):
    d = _read(spark, sf_dir, "conversations")
    return d.select("conv_id", "turn", F.posexplode(segment.chunk_lines(F.col("text"))).alias("chunk", "text"))


@query("SELECT conv_id, turn, CAST(turn // 4 AS BIGINT) AS batch FROM conversations")
def fixed_batches(spark, sf_dir):
    return segment.fixed_batches(_read(spark, sf_dir, "conversations"), 4, "turn").select("conv_id", "turn", "batch")


@query(r"""
WITH p AS (SELECT doc_id, text AS t, length(text) AS n, length(text) // 2 AS mid, string_split(text, '') AS c FROM documents),
s AS (SELECT doc_id, t, n, mid, list_filter(range(n), lambda o: c[o + 1] = ' ') AS places FROM p),
f AS (SELECT *, list_filter(places, lambda o: o <= 36 AND n - o - 1 <= 36) AS fits FROM s),
k AS (SELECT *, CASE WHEN len(fits) > 0 THEN fits ELSE places END AS pool FROM f),
b AS (SELECT *, list_min(list_transform(pool, lambda o: {'d': abs(o - mid), 'o': o})).o AS o FROM k)
SELECT doc_id, CASE WHEN n <= 36 THEN t WHEN o IS NULL THEN left(t, 36) || chr(10) || substr(t, 37) ELSE left(t, CAST(o AS INTEGER)) || chr(10) || substr(t, CAST(o AS INTEGER) + 2) END AS spaced,
       CASE WHEN n <= 18 THEN t ELSE left(t, 18) || chr(10) || substr(t, 19) END AS cjk FROM b
""")
def wrap_text(spark, sf_dir):
    """Whole texts."""
    return _read(spark, sf_dir, "documents").select("doc_id", T.wrap(F.col("text"), 36, " ").alias("spaced"), T.wrap(F.col("text"), 18, "").alias("cjk"))


@query(f"""
SELECT conv_id, CAST(count(*) AS BIGINT) AS n, sha256(string_agg((turn + 1) || '. ' || trim(replace(replace(left(text, 4000), chr(13), chr(10)), chr(10), ' / '), chr(32) || chr(9)), chr(10) ORDER BY turn)) AS message FROM conversations
WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(DISTINCT turn) = max(turn) + 1) GROUP BY conv_id
""")
def message_format(spark, sf_dir):
    rows = turns(spark, sf_dir).groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("seq", T.batch_line(F.col("text")).alias("t")))).alias("l"))
    rows = rows.where(F.get("l", F.size("l") - 1)["seq"] + 1 == F.size("l"))
    return rows.select(F.col("media_id").alias("conv_id"), F.size("l").cast("bigint").alias("n"), F.sha2(T.numbered_message(F.transform("l", lambda x: x["t"])).cast("binary"), 256).alias("message"))


@query(r"""
WITH m AS (SELECT conv_id, turn, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS t FROM conversations)
SELECT conv_id, turn, t AS parsed FROM m
""")
def item_parse(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    safe = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    item = F.concat(F.lit('<item index="'), F.col("turn").cast("string"), F.lit('"> '), safe, F.lit(" </item>"))
    reply = c.groupBy("conv_id").agg(F.concat(F.lit("```\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x["i"]), "\n"), F.lit("\n```")).alias("reply"))
    return reply.select("conv_id", F.explode(T.parse_response(F.col("reply"))).alias("p")).select("conv_id", F.col("p.k").cast("bigint").alias("turn"), F.col("p.v").alias("parsed"))


@query(r"""
WITH m AS (SELECT conv_id, turn, trim(regexp_replace(text, '[^\x21-\x7E]+', ' ', 'g')) AS t FROM conversations) SELECT conv_id, turn, t AS parsed FROM m WHERE t <> ''
""")
def line_parse(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    line = F.concat(F.lit("  "), F.col("turn").cast("string"), F.when(F.col("turn") % 2 == 0, F.lit(" : ")).otherwise(F.lit("- ")), F.regexp_replace("text", r"[^\x21-\x7E]+", " "))
    reply = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("i")))), lambda x: x["i"]), "\n").alias("reply"))
    return reply.select("conv_id", F.explode(T.parse_response(F.col("reply"))).alias("p")).select("conv_id", F.col("p.k").cast("bigint").alias("turn"), F.col("p.v").alias("parsed")).where("parsed <> ''")


@query(r"""
SELECT doc_id, array_to_string(list_transform(range(1, 4), lambda i: 'line ' || i || ' of ' || doc_id), '|') AS cleaned FROM documents
""")
def response_clean(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id")
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(i.cast("string"), F.lit(". line "), i.cast("string"), F.lit(" of "), F.col("doc_id").cast("string"))), "\r\n")
    k = F.col("doc_id") % 4
    reply = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Here are the lines\n\n"), body)).when(k == 2, F.concat(F.lit("```\n"), body, F.lit("\n```"))).otherwise(F.concat(body, F.lit("\nNote: done")))
    return d.select("doc_id", F.array_join(T.clean_lines(reply, F.lit(3)), "|").alias("cleaned"))


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS input, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 END AS output,
       'event ' || event_id AS text FROM events
""")
def json_usage(spark, sf_dir):
    rows = _replies(spark, sf_dir).select("event_id", M.usage(F.col("body")).alias("u"), M.message_text(F.col("body")).alias("text"))
    return rows.select("event_id", F.col("u.input").alias("input"), F.col("u.output").alias("output"), "text")


def _replies(spark, sf_dir):
    """Events as replies of a model: (event_id, event_type, k, body)."""
    e = _read(spark, sf_dir, "events")
    n = F.get_json_object("props", "$.k")
    more = (n.cast("bigint") + 1).cast("string")
    k = F.col("event_id") % 4
    use = F.when(k == 0, F.concat(F.lit('{"prompt_tokens": '), n, F.lit(', "completion_tokens": '), more, F.lit("}"))).when(k == 1, F.concat(F.lit('{"input_tokens": "'), n, F.lit('", "output_tokens": '), more, F.lit("}"))).when(k == 2, F.concat(F.lit('{"prompt_tokens": '), n, F.lit("}")))
    word = F.concat(F.lit("event "), F.col("event_id").cast("string"))
    content = F.when(k < 2, F.concat(F.lit('"'), word, F.lit('"'))).otherwise(F.concat(F.lit('[{"type": "text", "text": "event "}, {"content": "'), F.col("event_id").cast("string"), F.lit('"}]')))
    body = F.concat(F.lit('{"choices": [{"message": {"content": '), content, F.lit("}}]"), F.coalesce(F.concat(F.lit(', "usage": '), use), F.lit("")), F.lit("}"))
    return e.select("event_id", "event_type", k.alias("k"), body.alias("body"))


@query("""
WITH t AS (SELECT lang, CAST(sum((strlen(text) + 3) // 4) AS BIGINT) AS tokens FROM documents GROUP BY lang)
SELECT lang, tokens, round(tokens / 1000000.0::DOUBLE * 0.15::DOUBLE + tokens / 1000000.0::DOUBLE * 0.6::DOUBLE, 9) AS usd FROM t
""")
def token_cost(spark, sf_dir):
    t = _read(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(M.approximate_tokens(F.col("text"))).alias("tokens"))
    return t.select("lang", "tokens", F.round(M.cost_usd(F.lit("gpt-4o-mini"), F.col("tokens"), F.col("tokens")), 9).alias("usd"))


@query("SELECT doc_id, sha256(doc_id || '|' || lang || '|' || source) AS key FROM documents")
def stage_key(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.content_key(F.col("doc_id").cast("string"), F.col("lang"), F.col("source")).alias("key"))


@query("""
WITH r AS (SELECT l_orderkey AS media_id, CAST(l_linenumber - 1 AS BIGINT) AS idx, max(l_partkey) AS part FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY idx) - 1 AS n FROM r)
SELECT media_id, idx AS index, part FROM p WHERE idx = n
""")
def contiguous_records(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("media_id"), (F.col("l_linenumber") - 1).cast("bigint").alias("index"), F.col("l_partkey").alias("part"))
    return contiguous_prefix(li, order="part").select("media_id", "index", "part")


@query("SELECT s_suppkey AS media_id, unnest(range(CAST(greatest(1, ceil((s_suppkey % 7) * 0.4::DOUBLE * 3)) AS BIGINT))) AS frame FROM supplier")
def frame_grid(spark, sf_dir):
    s = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("media_id"), ((F.col("s_suppkey") % 7) * F.lit(0.4)).alias("duration_s"))
    return frames.frame_grid(s, 3).select("media_id", "frame")


@query(f"""
WITH {BOXES}, p AS (SELECT *, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE y END AS q FROM boxes)
SELECT media_id, CAST(frame AS BIGINT) AS frame, l_partkey, coalesce(sqrt((x - 0.5) * (x - 0.5) + (q - 0.5) * (q - 0.5)) <= 0.05, false) AS near_center, q IS NULL AS near_nothing FROM p
""")
def near_positions(spark, sf_dir):
    q = F.when(F.col("l_partkey") % 7 != 0, F.col("y"))
    half, none = F.lit(0.5), F.lit(None).cast("double")
    return boxes(spark, sf_dir).select("media_id", "frame", "l_partkey", G.near(F.col("x"), q, half, half).alias("near_center"), G.near(F.when(q.isNotNull(), F.col("x")), q, none, none).alias("near_nothing"))


def _placed(spark, sf_dir):
    style = lambda s: F.array(F.struct(F.lit("Style").alias("key"), F.lit(s).alias("value")))
    over = cues(spark, sf_dir, "view").withColumn("attributes", style(layout.OVERLAY))
    talk = cues(spark, sf_dir, "click").withColumn("attributes", style(layout.DIALOGUE))
    both = over.unionByName(talk).withColumn("x", F.lit(0.25)).withColumn("raw_text", F.lit("sign")).withColumn("font_height", F.lit(0.05))
    return layout.place(both, 1280, 720).where(G.attribute(F.col("attributes"), "Style") == layout.OVERLAY)


@query(rf"""
WITH RECURSIVE v AS ({_cues_sql('view')}), c AS ({_cues_sql('click')}),
k AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, y, seq) AS n FROM v
      WHERE y < 0.16::DOUBLE + 0.04::DOUBLE AND EXISTS (SELECT 1 FROM c WHERE c.media_id = v.media_id AND v.start_ms < c.end_ms AND c.start_ms < v.end_ms)),
f AS (
  SELECT media_id, seq, n, 1 AS lane, [end_ms] AS ends FROM k WHERE n = 1
  UNION ALL
  SELECT media_id, seq, n, lane, CASE WHEN lane > len(ends) THEN list_append(ends, end_ms) ELSE list_transform(ends, lambda e, i: CASE WHEN i = lane THEN greatest(e, end_ms) ELSE e END) END
  FROM (SELECT k.media_id, k.seq, k.n, k.end_ms, f.ends, coalesce(list_position(list_transform(f.ends, lambda e: e <= k.start_ms), true), len(f.ends) + 1) AS lane
        FROM f JOIN k ON k.media_id = f.media_id AND k.n = f.n + 1)),
p AS (SELECT v.media_id, v.seq, CASE WHEN lane IS NULL THEN v.y ELSE greatest(v.y, least(0.16::DOUBLE + 0.04::DOUBLE * (lane - 1), 1)) END AS y FROM v LEFT JOIN f ON f.media_id = v.media_id AND f.seq = v.seq)
SELECT media_id, seq, '{{\an4\pos(320,' || CAST(round((1 - y) * 720) AS BIGINT) || ')}}sign' AS display_text FROM p
""")
def placed_cues(spark, sf_dir):
    """Every overlay cue with its text as displayed."""
    return _placed(spark, sf_dir).select("media_id", "seq", "display_text")


ASS_TIME = "(ms // 3600000) || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms // 10 % 100 AS VARCHAR), 2, '0')"


@query(rf"""
WITH c AS ({_cues_sql('click')}),
d AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seq) AS line_no,
             'Dialogue: 0,' || {ASS_TIME.replace("ms", "start_ms")} || ',' || {ASS_TIME.replace("ms", "end_ms")} || ',BottomDialogue,,0,0,0,,a\Nb' AS line FROM c)
SELECT media_id, CAST(line_no AS BIGINT) AS line_no, line FROM d
UNION ALL SELECT DISTINCT media_id, 0::BIGINT, '{layout.ASS_HEAD.format(w=G.PLAY_WIDTH, h=G.PLAY_HEIGHT)}' FROM c
""")
def ass_documents(spark, sf_dir):
    talk = cues(spark, sf_dir, "click").withColumn("attributes", F.array(F.struct(F.lit("Style").alias("key"), F.lit(layout.DIALOGUE).alias("value")))).withColumn("display_text", F.lit("a\nb"))
    return layout.ass_lines(talk)


REGIONS = """NOT ((cx >= 0.2 AND cx < 0.8 AND cy >= 0.85 AND cy < 1.0) OR (cx >= 0 AND cx < 0.2 AND cy >= 0.65 AND cy < 1.0) OR (cx >= 0.8 AND cx < 1.0 AND cy >= 0.65 AND cy < 1.0)
  OR (cx >= 0 AND cx < 1.0 AND cy >= 0 AND cy < 0.1) OR (cx >= 0 AND cx < 0.2 AND cy >= 0 AND cy < 0.15) OR (cx >= 0.8 AND cx < 1.0 AND cy >= 0 AND cy < 0.15))
  AND h * 720 >= CAST(CAST(0.02 AS FLOAT) AS DOUBLE) * 720 AND NOT (w * 1.05 < h)"""
SHOWN = "CASE WHEN w * h < 0.0055 THEN '(' || l_partkey || ')' ELSE CAST(l_partkey AS VARCHAR) END"


def observations(spark, sf_dir):
    """Line items as observations of a frame."""
    return boxes(spark, sf_dir).select("media_id", "frame", F.struct("l_partkey", "l_suppkey").alias("seq"), F.col("l_partkey").cast("string").alias("text"), *"xywh")


@query(f"""
WITH {BOXES}, c AS (SELECT *, x + w / 2 AS cx, y + h / 2 AS cy FROM boxes)
SELECT media_id, CAST(frame AS BIGINT) AS frame, {SHOWN} AS text, least(greatest(x + w, 0), 1) AS x, least(greatest((y + (y + h)) / 2, 0), 1) AS y, least(greatest(h, 0), 1) AS font_height FROM c WHERE {REGIONS}
""")
def positioned_frame_text(spark, sf_dir):
    return frames.frame_texts(observations(spark, sf_dir), 720, profile("default"), positioned=True, rtl=True)


@query(f"""
WITH {BOXES}, c AS (SELECT *, x + w / 2 AS cx, y + h / 2 AS cy FROM boxes)
SELECT media_id, CAST(frame AS BIGINT) AS frame, string_agg({SHOWN}, chr(92) || 'N' ORDER BY l_partkey, l_suppkey) AS text, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS font_height
FROM c WHERE {REGIONS} GROUP BY media_id, frame
""")
def filtered_frame_text(spark, sf_dir):
    return frames.frame_texts(observations(spark, sf_dir), 720, profile("default"))


@query(f"""
WITH {BOXES} SELECT media_id, CAST(frame AS BIGINT) AS frame, string_agg({SHOWN}, chr(92) || 'N' ORDER BY l_partkey, l_suppkey) AS text, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS font_height
FROM boxes GROUP BY media_id, frame
""")
def unfiltered_frame_text(spark, sf_dir):
    return frames.frame_texts(observations(spark, sf_dir), 720, profile("unfiltered"))


@query(f"""
WITH {BOXES}, c AS (SELECT *, x + w / 2 AS cx, y + h / 2 AS cy FROM boxes WHERE frame < 4)
SELECT media_id, CAST(frame AS BIGINT) AS frame, {SHOWN} AS text, least(greatest(x, 0), 1) AS x, least(greatest((y + (y + h)) / 2, 0), 1) AS y, least(greatest(h, 0), 1) AS font_height FROM c WHERE {REGIONS}
""")
def rederived_frame_text(spark, sf_dir):
    """Stored raw observations, cut at a frame count and filtered by the profile of today."""
    records = boxes(spark, sf_dir).groupBy("media_id", F.col("frame").alias("index")).agg(F.collect_list(F.struct(F.col("l_partkey").cast("string").alias("text"), *"xywh")).alias("observations"))
    return frames.rederive(records, 4, 720, profile("default"), positioned=True)


@query(f"""
WITH {BOXES} SELECT media_id, CAST(frame AS BIGINT) AS frame, l_partkey, printf('%.6f', x) AS position_x, CAST(printf('%.6f', h) AS DOUBLE) AS font_height FROM boxes
""")
def attribute_numbers(spark, sf_dir):
    pair = lambda k, c: F.struct(F.lit(k).alias("key"), G.encode_number(F.col(c)).alias("value"))
    rows = boxes(spark, sf_dir).withColumn("attributes", F.array(pair("PositionX", "x"), pair("FontHeight", "h")))
    return rows.select("media_id", "frame", "l_partkey", G.attribute(F.col("attributes"), "PositionX").alias("position_x"), G.decode_number(F.col("attributes"), "FontHeight").alias("font_height"))


def results(spark, sf_dir):
    """Events as recognition results: without runs, with a blank run, and with a run."""
    e = _read(spark, sf_dir, "events")
    run = lambda text: F.array(F.struct(text.alias("text"), F.col("value").alias("start_s"), F.lit(0.5).alias("duration_s")))
    padded = F.concat(F.lit("\t"), F.col("event_type"), F.lit(" "))
    none = F.array().cast("array<struct<text:string,start_s:double,duration_s:double>>")
    runs = F.when(F.col("event_id") % 4 == 0, none).when(F.col("event_id") % 4 == 1, run(F.lit(" \t"))).otherwise(run(padded))
    return e.select(F.col("user_id").alias("media_id"), F.col("event_id").alias("result"), padded.alias("text"), runs.alias("runs"))


@query("""
SELECT user_id AS media_id, event_id AS result, 0 AS n, event_type AS text, CASE WHEN event_id % 4 < 2 THEN 0 ELSE CAST(trunc(value * 1000) AS BIGINT) END AS start_ms,
       CASE WHEN event_id % 4 < 2 THEN 1000 ELSE CAST(trunc((value + 0.5) * 1000) AS BIGINT) END AS end_ms FROM events
""")
def word_cue_extraction(spark, sf_dir):
    return incremental.word_cues(results(spark, sf_dir))


@query("SELECT user_id AS media_id, max(CASE WHEN event_id % 4 = 0 THEN 0 ELSE value + 0.5 END) AS end_s FROM events GROUP BY user_id")
def max_end(spark, sf_dir):
    return results(spark, sf_dir).groupBy("media_id").agg(F.max(incremental.end_seconds(F.col("runs"))).alias("end_s"))


USE = """use AS (SELECT event_type, event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS i,
  CASE WHEN event_id % 4 < 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 WHEN event_id % 4 = 2 THEN 0 END AS o FROM events)"""


@query(f"""
WITH {USE}, t AS (SELECT event_type, CAST(sum(i) AS BIGINT) AS input, CAST(sum(o) AS BIGINT) AS output, count(*) AS replies, count(i) AS metered FROM use GROUP BY event_type)
SELECT event_type, input, output, replies, metered, 'gpt-4o: $' || printf('%.4f', input / 1000000.0::DOUBLE * 2.5::DOUBLE + output / 1000000.0::DOUBLE * 10.0::DOUBLE) || ' (' || metered || ' of ' || replies || ' replies metered, ' || input || ' tokens in, ' || output || ' out)' AS summary FROM t
UNION ALL SELECT 'none', 0, 0, count(*), 0, 'cost unknown: no reply told its usage' FROM use WHERE event_id % 4 = 3
""")
def usage_summary(spark, sf_dir):
    rows = _replies(spark, sf_dir).select("event_type", "k", M.usage(F.col("body")).alias("u"))
    both = rows.unionByName(rows.where("k = 3").withColumn("event_type", F.lit("none")))
    total = both.groupBy("event_type").agg(*M.usage_totals(F.col("u")))
    line = M.cost_summary(F.lit("gpt-4o"), F.col("input"), F.col("output"), F.col("metered"), F.col("replies"))
    return total.select("event_type", "input", "output", "replies", "metered", line.alias("summary"))


MODELS = ("gpt-4o-mini", "gpt-4o", "gpt-5-nano", "GPT-5.4-nano", "other", "gpt-4.1")


@query("""
WITH p AS (SELECT *, lower(['gpt-4o-mini', 'gpt-4o', 'gpt-5-nano', 'GPT-5.4-nano', 'other', 'gpt-4.1'][p_partkey % 6 + 1]) AS m, [' Bearer ', '', 'X-API-Key', 'api-key', 'basic'][p_partkey % 5 + 1] AS a FROM part)
SELECT p_partkey, CASE WHEN m LIKE 'gpt-5%' THEN NULL ELSE 0.3::DOUBLE END AS temperature, CASE WHEN m LIKE 'gpt-5.4%' THEN 'none' WHEN m LIKE 'gpt-5%' THEN 'low' END AS effort,
       CASE WHEN m LIKE '%gpt-5.4-nano%' THEN 0.2 WHEN m LIKE '%gpt-4o-mini%' THEN 0.15 WHEN m LIKE '%gpt-4o%' THEN 2.5 ELSE 0.05 END::DOUBLE AS usd_in,
       CASE WHEN lower(trim(a)) IN ('', 'bearer') THEN 'Authorization' WHEN lower(a) IN ('x-api-key', 'api-key') THEN 'x-api-key' END AS header FROM p
""")
def model_parameters(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    model = F.get(F.array(*map(F.lit, MODELS)), (F.col("p_partkey") % 6).cast("int"))
    mode = F.get(F.array(*map(F.lit, (" Bearer ", "", "X-API-Key", "api-key", "basic"))), (F.col("p_partkey") % 5).cast("int"))
    return p.select("p_partkey", M.temperature(model).alias("temperature"), M.reasoning_effort(model).alias("effort"), M.price(model, 0).alias("usd_in"), M.auth_header(mode).alias("header"))


@query(r"""
SELECT conv_id, count(*) AS requests, CAST(0 AS DOUBLE) AS usd_device, CAST(NULL AS DOUBLE) AS usd_metered, count(*) || ' requests, billed by their replies' AS note FROM conversations GROUP BY conv_id
""")
def cost_estimate(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("requests"), F.sum(F.size(segment.chunk_lines(F.col("text")))).alias("calls"))
    device, metered = (M.estimate(F.col("requests"), F.col("calls"), m) for m in (False, True))
    return c.select("conv_id", "requests", device["usd"].alias("usd_device"), metered["usd"].alias("usd_metered"), metered["note"].alias("note"))


@query(r"""
WITH t AS (SELECT conv_id, nullif(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '') AS t FROM conversations)
SELECT conv_id AS media_id, count(*) AS cues, count(DISTINCT t) AS unique_texts, CAST(coalesce((SELECT sum(len(string_split(u, chr(10)))) FROM (SELECT DISTINCT t AS u FROM t b WHERE b.conv_id = a.conv_id AND t IS NOT NULL)), 0) AS BIGINT) AS lines
FROM t a GROUP BY conv_id
""")
def translation_counts(spark, sf_dir):
    return translate.counts(turns(spark, sf_dir))


def _upper_service(url, headers, body):
    """A service that answers each numbered line in capitals, and every batch of more than five with a line too few."""
    asked = json.loads(body)["messages"][1]["content"].split("\n")
    lines = [line.upper() for line in (asked[:-1] if len(asked) > 5 else asked)]
    return 200, json.dumps({"choices": [{"message": {"content": "\n".join(lines)}}]})


@query(r"""
WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '[^\x21-\x7E]+', ' ', 'g')) AS t FROM conversations) SELECT conv_id AS media_id, turn AS seq, upper(t) AS translated FROM c
""")
def translate_chat(spark, sf_dir):
    """Numbered batches through a chat service that drops lines of large batches, so that halves are tried."""
    translate.register("upper-chat", providers.ChatProvider(_upper_service, "key", "gpt-4o-mini", most_items=20, depth=8, per_second=1e6))
    rows = turns(spark, sf_dir).withColumn("text", T.trim_all(F.regexp_replace("text", r"[^\x21-\x7E]+", " ")))
    return translate.translate(rows, "upper-chat").select("media_id", "seq", "translated")


@query(r"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x' || text WHEN doc_id % 3 = 1 THEN '[Script Info]' || chr(10) || 'ScriptType: v4.00+' || chr(10) || 'PlayResX: 1920' || chr(10) || 'PlayResY: 1080' || chr(10) || chr(10) || text
       ELSE 'PlayResX: 1' || chr(10) || 'ScriptType: v4.00+' || text END AS document FROM documents
""")
def header_injection(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    k = F.col("doc_id") % 3
    made = F.when(k == 0, F.concat(F.lit("x"), "text")).when(k == 1, F.concat(F.lit("[Script Info]\nScriptType: v4.00+\n"), "text")).otherwise(F.concat(F.lit("PlayResX: 1\nScriptType: v4.00+"), "text"))
    return d.select("doc_id", layout.with_play_size(made, 1920, 1080).alias("document"))


@query(f"""
WITH {BOXES} SELECT media_id, CAST(frame AS BIGINT) AS frame, l_partkey, CASE WHEN l_partkey % 4 = 0 THEN h ELSE abs(x - 0.5) END AS size FROM boxes WHERE l_partkey % 4 = 0 OR x <> 0.5
UNION ALL SELECT media_id, CAST(frame AS BIGINT), l_partkey, h FROM boxes WHERE l_partkey % 4 <> 0 AND x = 0.5
""")
def presentation_size(spark, sf_dir):
    size = F.when(F.col("l_partkey") % 4 == 0, F.lit(0.0)).otherwise(F.col("x") - 0.5)
    return boxes(spark, sf_dir).select("media_id", "frame", "l_partkey", G.presentation(size, -F.col("h")).alias("size"))


@query(r"""
SELECT event_id, 'http://host/' || event_type AS url, 'a' || chr(9) || 'b' || event_id AS clean, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, epoch(date_trunc('second', ts)) AS seconds,
       '{"model":"m","temperature":' || CASE WHEN event_id % 2 = 0 THEN '0.3}' ELSE '0.3,"reasoning_effort":"low"}' END AS body, CASE event_id % 3 WHEN 0 THEN 'bad ' || event_id WHEN 1 THEN 'worse' ELSE 'no json' END AS problem FROM events
""")
def request_parts(spark, sf_dir):
    """The small change of requests: addresses, controls, times, bodies and errors."""
    e = _read(spark, sf_dir, "events")
    n = F.col("event_id")
    path = F.when(n % 2 == 0, F.concat(F.lit("/"), "event_type")).otherwise(F.col("event_type"))
    reply = F.when(n % 3 == 0, F.concat(F.lit('{"error": {"message": "bad '), n.cast("string"), F.lit('"}}'))).when(n % 3 == 1, F.lit('{"detail": "worse"}')).otherwise(F.lit("no json"))
    iso = to_iso(F.col("ts").cast("timestamp"))
    none = F.lit(None).cast("array<string>")
    body = M.request_body(F.lit("m"), none, F.lit(0.3), F.when(n % 2 == 1, "low"))
    clean = T.drop_controls(F.concat(F.lit("a\t\x01\x0bb\x1f"), n.cast("string")))
    return e.select("event_id", T.join_url(F.lit("http://host//"), path).alias("url"), clean.alias("clean"), iso.alias("iso"), F.unix_timestamp(from_iso(iso)).cast("double").alias("seconds"), body.alias("body"), M.error_detail(reply).alias("problem"))


@query("""
WITH r AS (SELECT l_orderkey AS media_id, CAST(l_linenumber - 1 AS BIGINT) AS idx, max(l_partkey) AS part FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY idx) - 1 AS n FROM r),
z AS (SELECT media_id, count(*) AS next_index, arg_max(part, idx) AS fingerprint FROM p WHERE idx = n GROUP BY media_id)
SELECT media_id, CAST(next_index AS BIGINT) AS next_index, fingerprint FROM z
""")
def resume_points(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("media_id"), (F.col("l_linenumber") - 1).cast("bigint").alias("index"), F.col("l_partkey").alias("written"), F.col("l_partkey").alias("fingerprint"), F.lit("o").alias("observations"))
    return incremental.resume_point(li).select("media_id", "next_index", "fingerprint")


@query("""
WITH a AS (SELECT conv_id, turn FROM conversations), b AS (SELECT conv_id, turn + 1 AS turn FROM conversations WHERE turn < 3 UNION ALL SELECT conv_id, 0 FROM conversations WHERE turn IN (0, 1)),
t AS (SELECT conv_id, turn, count(*) AS n FROM b GROUP BY 1, 2)
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn, CASE WHEN a.conv_id IS NULL THEN 'unknown id' WHEN b.conv_id IS NULL THEN 'no reply' WHEN t.n > 1 THEN 'repeated id' END AS problem
FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn LEFT JOIN t ON t.conv_id = b.conv_id AND t.turn = b.turn
""")
def reply_ids(spark, sf_dir):
    """Replies with ids that were not asked for, were given twice, or are missing."""
    c = _read(spark, sf_dir, "conversations").select("conv_id", "turn")
    moved = c.where("turn < 3").withColumn("turn", F.col("turn") + 1).unionAll(c.where("turn in (0, 1)").withColumn("turn", F.lit(0).cast(c.schema["turn"].dataType)))
    return translate.check_ids(c, moved, ["conv_id", "turn"])
