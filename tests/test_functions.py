import random

import pytest
from pyspark.sql import functions as F

from cuemill.functions import distance
from cuemill.functions import geometry as G
from cuemill.functions import messages as M
from cuemill.functions import text as T
from cuemill.operators import frames, layout, segment, translate
from cuemill.plans.settings import PhraseLimits, profile, validate
from cuemill.sources.store import StageStore, contiguous_prefix, read_frames, write_documents
from cuemill.streaming.incremental import ingest_frames, word_cues


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column).first()[0]


def pairs(got):
    return None if got is None else {r["k"]: r["v"] for r in got}


def test_items_and_entities(spark):
    reply = '<item index="3">salt &amp; pepper</item> and <item index="1">\n &gt;&gt; loud \n</item><item index="3">&quot;2 &amp;lt; 3&quot;</item>'
    assert pairs(one(spark, T.parse_response(F.lit(reply)))) == {3: '"2 &lt; 3"', 1: ">> loud"}
    assert pairs(one(spark, T.parse_response(F.lit('x <item  index="12"><![CDATA[ <b>&apos;</b> ]]></item>')))) == {12: "<b>&apos;</b>"}


def test_numbered_lines_and_garbage(spark):
    assert pairs(one(spark, T.parse_response(F.lit("```text\n  7 : seven\n8-eight\n8: acht\n```")))) == {7: "seven", 8: "acht"}
    assert one(spark, T.parse_response(F.lit("no numbers here"))) is None
    with pytest.raises(Exception, match="neither items nor"):
        one(spark, T.parse_response_strictly(F.lit("no numbers here")))


def test_messages(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, T.context_message(F.lit("hi"), empty, empty)) == "hi"
    assert one(spark, F.length(T.context_message(F.lit("x" * 4020), empty, empty))) == 4000
    full = one(spark, T.context_message(F.lit("hi"), F.array(F.lit("a")), F.array(F.lit("b"))))
    assert full == f"{T.BEFORE}\na\n\n{T.THIS}\nhi\n\n{T.AFTER}\nb"
    assert one(spark, T.single_message(F.lit("hi"), F.array(F.lit("a")), empty)) == "Context before:\n\na\n\nText:\n\nhi"


def words(spark, rows):
    return spark.createDataFrame([(1, i, a, b, t) for i, (a, b, t) in enumerate(rows)], "media_id bigint, seq bigint, start_ms bigint, end_ms bigint, text string")


def test_phrases(spark):
    got = segment.phrases(words(spark, [(40, 200, "gone"), (260, 700, "fishing")])).collect()
    assert [(r.plain_text, r.start_ms, r.end_ms) for r in got] == [("gone fishing", 40, 700)]
    assert segment.phrases(words(spark, [(0, 90, "now"), (690, 800, "then")])).count() == 2
    wrapped = segment.phrases(words(spark, [(i * 50, i * 50 + 40, "lorem") for i in range(6)]), PhraseLimits(most_chars=99, line_chars=18)).first()
    assert wrapped.plain_text == "lorem lorem lorem\nlorem lorem lorem" and "\\N" in wrapped.raw_text
    assert PhraseLimits.for_locale("ja-JP", pause_ms=5) == PhraseLimits(5, 7000, 36, 18, "") and PhraseLimits.for_locale("EN") == PhraseLimits()


def plain_phrases(rows, limits):
    """Phrases by a walk over one medium's words."""
    out = []
    for start, end, text in rows:
        last = out[-1] if out else None
        joined = None if last is None else limits.separator.join([*last[2], text])
        if last and start - last[1] < limits.pause_ms and len(joined) <= limits.most_chars and end - last[0] <= limits.most_ms:
            last[1] = end
            last[2].append(text)
        else:
            out.append([start, end, [text]])
    return [(a, b, len(t)) for a, b, t in out]


def test_phrases_against_a_walk(spark):
    rng = random.Random(11)
    at, rows = 0, []
    for _ in range(3000):
        at += rng.randint(0, 700)
        rows.append((at, at + rng.randint(1, 400), "x" * rng.randint(1, 12)))
    limits = PhraseLimits(pause_ms=650, most_ms=3000, most_chars=40)
    got = segment.phrases(words(spark, rows), limits).orderBy("phrase").collect()
    assert [(r.start_ms, r.end_ms, r.n_words) for r in got] == plain_phrases(rows, limits)


def test_wrapping(spark):
    assert one(spark, T.wrap(F.lit("一二三四五"), 3, "")) == "一二三\n四五"
    assert one(spark, T.wrap(F.lit("abcdefgh"), 3, " ")) == "abc\ndefgh"
    assert T.locale_limits("ko-KR") == (18, 36, " ") and T.locale_limits("en-US") == (36, 52, " ") and T.locale_limits("ja")[2] == ""


def test_position_tags(spark):
    x, y = F.lit(0.1), F.lit(0.4)
    assert one(spark, G.override_prefix(x, y, 1000, 500)) == "{\\an4\\pos(100,300)}"
    assert one(spark, G.override_prefix(F.lit(1.4), y, 1000, 500, rtl=True)) == "{\\an6\\pos(1000,300)}"
    assert [one(spark, G.font_size(F.lit(h), 1000)) for h in (0.001, 0.05, 0.5)] == [34, 43, 64]
    none = F.lit(None).cast("double")
    assert [one(spark, G.near(*p)) for p in ((none, none, none, none), (none, none, x, y), (x, y, none, none), (x, y, x + 0.03, y - 0.03))] == [True, False, False, True]


def _cue(seq, start, end, y, style):
    return (1, seq, start, end, "sign", [("Style", style)], 0.25, y, None)


CUES = "media_id bigint, seq bigint, start_ms bigint, end_ms bigint, raw_text string, attributes array<struct<key:string,value:string>>, x double, y double, font_height double"


def test_avoids_dialogue(spark):
    rows = [_cue(1, 10, 90, 0.02, layout.OVERLAY), _cue(2, 20, 80, 0.18, layout.OVERLAY), _cue(3, 50, 60, None, layout.DIALOGUE), _cue(4, 200, 300, 0.02, layout.OVERLAY)]
    cues = spark.createDataFrame(rows, CUES)
    got = {r.seq: r.display_text for r in layout.place(cues, 400, 1000).collect()}
    assert got == {1: "{\\an4\\pos(100,840)}sign", 2: "{\\an4\\pos(100,800)}sign", 3: "sign", 4: "{\\an4\\pos(100,980)}sign"}
    assert {r.display_text for r in layout.place(cues, 400, 1000, positions=False).collect()} == {"sign"}


def test_profiles():
    assert not profile("unfiltered").filter_regions and profile("default").skip_similar
    with pytest.raises(ValueError):
        profile("nope")
    with pytest.raises(ValueError):
        validate(0.5)


def test_edit_distance_counts_code_points(spark):
    assert one(spark, T.edit_distance(F.lit("é"), F.lit("e"))) == 1.0
    assert one(spark, T.edit_distance(F.lit(""), F.lit("e"))) == 1.0
    assert one(spark, T.edit_distance(F.lit("abcde"), F.lit("abcdx")) < F.lit(0.2).cast("float")) is False


def test_collapse_carries_the_anchor_over_gaps(spark):
    rows = spark.createDataFrame([(1, 0, "aaaaaaaaaa"), (1, 5, "aaaaaaaaab"), (1, 6, "aaaaaaaabb"), (1, 9, "zz")], "media_id bigint, seq bigint, text string")
    got = {r.seq: r.anchor_seq for r in segment.collapse_similar(rows).collect()}
    assert got == {0: 0, 5: 0, 6: 6, 9: 9}


def test_chunks(spark):
    assert one(spark, segment.chunk_lines(F.lit("ab\\Ncd\nlonger line here"), 8)) == ["ab\ncd", "longer l", "ine here"]


def test_model_replies(spark):
    body = F.lit('{"choices":[{"message":{"content":[{"text":"a"},{"content":"b"}]}}],"usage":{"input_tokens":"7"}}')
    assert one(spark, M.message_text(body)) == "ab"
    assert tuple(one(spark, M.usage(body))) == (7, 0)
    assert one(spark, M.error_detail(F.lit('{"error":{"message":"bad"}}'))) == "bad"
    assert one(spark, M.approximate_tokens(F.lit("é"))) == 1
    assert one(spark, T.join_url(F.lit("http://a//"), F.lit("v1"))) == "http://a/v1"


def brute_tracks(rows, below=0.2):
    """A plain model: all frames of a medium at once, tracks kept in a list."""
    tracks = []
    for f in sorted({r[0] for r in rows}):
        taken = set()
        for _, text, x, y in sorted((r for r in rows if r[0] == f), key=lambda r: (-r[3], r[2])):
            near = [(((t["x"] - x) ** 2 + (t["y"] - y) ** 2) ** 0.5, k) for k, t in enumerate(tracks) if t["end"] == f and k not in taken]
            near = [(d, k) for d, k in near if d <= 0.05 and distance.ratio(tracks[k]["text"], text) < below]
            if near:
                k = min(near)[1]
                tracks[k]["end"] = f + 1
            else:
                k = len(tracks)
                tracks.append({"start": f, "end": f + 1, "text": text, "x": x, "y": y})
            taken.add(k)
    return sorted((t["start"], t["end"], t["text"], t["x"], t["y"]) for t in tracks)


def test_tracks_against_a_model(spark):
    rng = random.Random(5)
    rows = [(f, rng.choice(["sign", "sigm", "shop"]), rng.randint(0, 4) / 50, rng.randint(0, 4) / 50) for f in range(30) if f % 7 for _ in range(rng.randint(0, 3))]
    rows = list({(f, x, y): (f, t, x, y) for f, t, x, y in rows}.values())
    got = frames.track(spark.createDataFrame([(1, *r) for r in rows], "media_id bigint, frame bigint, text string, x double, y double")).collect()
    assert sorted((r.first_frame, r.end_frame, r.text, r.x, r.y) for r in got) == brute_tracks(rows)


def test_store(spark, tmp_path):
    made = []

    def create():
        made.append(1)
        return spark.createDataFrame([(1, 1, 0, 10, "a", "a", [("Style", "x")])], "media_id bigint, seq bigint, start_ms bigint, end_ms bigint, raw_text string, plain_text string, attributes array<struct<key:string,value:string>>")

    for resume, calls in ((True, 1), (True, 1), (False, 2)):
        store = StageStore(spark, str(tmp_path), resume)
        assert store.load_or_create("speech", "k", create).first().raw_text == "a" and len(made) == calls
    assert not StageStore(spark, str(tmp_path)).reusable("speech", "other")


def test_records(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 2, 3, "c")], "media_id bigint, index bigint, written bigint, text string")
    assert [(r["index"], r.text) for r in contiguous_prefix(rows).collect()] == [(0, "b")]
    path = tmp_path / "frames"
    path.mkdir()
    (path / "a.json").write_text('{"media_id":1,"index":0,"text":"x"}\nnot json\n{"media_id":1,"index":0,"text":"y"}\n{"media_id":1,"index":1,"text":"z"}\n')
    assert sorted((r["index"], r["text"]) for r in read_frames(spark, str(path)).collect()) == [(0, "y"), (1, "z")]


def test_documents(spark, tmp_path):
    cues = spark.createDataFrame([(1, 2, 61_230, 62_000, "b", []), (1, 1, 0, 500, "a", [("Style", "TopOCR")])], "media_id bigint, seq bigint, start_ms bigint, end_ms bigint, display_text string, attributes array<struct<key:string,value:string>>")
    write_documents(layout.ass_lines(cues), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out" / "media_id=1").glob("*.txt"))
    assert text.index("PlayResX: 1920") < text.index("Dialogue: 0,0:00:00.00,0:00:00.50,TopOCR,,0,0,0,,a") < text.index("Dialogue: 0,0:01:01.23,0:01:02.00,BottomDialogue")


def test_streaming(spark, tmp_path):
    src = tmp_path / "src"
    spark.range(5).selectExpr("1L AS media_id", "id AS index").coalesce(1).write.json(str(src))
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.schema("media_id bigint, index bigint").json(str(src))
        ingest_frames(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 5


def test_word_cues(spark):
    rows = spark.createDataFrame([(1, 0, "a b", [(" a ", 0.5, 0.25), (" ", 1.0, 0.1)]), (1, 1, "c", [])], "media_id bigint, result bigint, text string, runs array<struct<text:string,start_s:double,duration_s:double>>")
    assert sorted((r.text, r.start_ms, r.end_ms) for r in word_cues(rows).collect()) == [("a", 500, 750), ("c", 0, 1000)]


def test_word_cues_of_blank_runs(spark):
    schema = "media_id bigint, result bigint, text string, runs array<struct<text:string,start_s:double,duration_s:double>>"
    rows = spark.createDataFrame([(1, 0, " whole ", [("  ", 1.0, 0.5)]), (1, 1, "x", [("\ta\t", 1.0, 0.5), ("b", None, None)]), (1, 2, " ", [])], schema)
    got = sorted((r.result, r.text, r.start_ms, r.end_ms) for r in word_cues(rows).collect())
    assert got == [(0, "whole", 0, 1000), (1, "a", 1000, 1500)]


def test_retry_halves():
    calls = []

    def fussy(texts, before, after):
        calls.append(len(texts))
        return texts if len(texts) < 3 else texts[:-1]

    assert translate.retry_halves(fussy, list("abcde"), [[]] * 5, [[]] * 5) == list("abcde") and calls[0] == 5
