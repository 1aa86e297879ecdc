"""Providers, the stage store's manifest, settings and resumption."""

import contextlib
import json
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle

from cuemill.operators import frames, providers, translate
from cuemill.plans.settings import profile, setting
from cuemill.sources.store import StageStore, fingerprint, key_of, workspace
from cuemill.streaming.incremental import pause_segments, progress, remaining, resume_point


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors have no module of tests


class Service:
    """Answers numbered lines in capitals; every batch of more than most lines loses its last."""

    def __init__(self, most=3, status=200):
        self.most, self.status, self.asked = most, status, []

    def __call__(self, url, headers, body):
        sent = json.loads(body)
        self.asked.append((url, headers, sent))
        lines = sent["messages"][1]["content"].split("\n")
        lines = lines[: len(lines) - (len(lines) > self.most)]
        return self.status, json.dumps({"choices": [{"message": {"content": "\n".join(lines).upper()}}]})


def ask(service, texts, **settings):
    chat = providers.ChatProvider(service, "k", settings.pop("model", "gpt-4o"), per_second=1e9, **settings)
    return chat(texts, [[]] * len(texts), [[]] * len(texts))


def test_chat_batches_and_halves():
    service = Service()
    assert ask(service, [f"line {k}" for k in range(10)] + [" "]) == [f"LINE {k}" for k in range(10)] + [" "]
    assert max(len(s["messages"][1]["content"].split("\n")) for _, _, s in service.asked) == 10
    url, headers, body = service.asked[0]
    assert url == "http://localhost/v1/chat/completions" and headers["Authorization"] == "Bearer k" and body["temperature"] == 0.3
    service = Service(most=0)  # even single lines fail as a batch, so each gets a prompt of its own
    got = ask(service, ["a", "b"], model="gpt-5.4-x", header="x-api-key")
    assert got == ["TEXT:", "TEXT:"] and len(service.asked) == 5 and service.asked[-1][2]["messages"][0]["content"].startswith("Translate the text")
    assert service.asked[0][2]["reasoning_effort"] == "none" and "temperature" not in service.asked[0][2] and service.asked[0][1]["x-api-key"] == "k"
    with pytest.raises(OSError):
        ask(Service(status=500), ["a"])
    with pytest.raises(providers.ProviderError):
        ask(Service(most=1), [str(k) for k in range(40)], depth=1)
    with pytest.raises(ValueError):
        providers.ChatProvider(Service(), "", "m").validate()


def test_reply_lines():
    assert providers.reply_lines("```\n1. a\n2) b\n```", 2) == ["a", "b"]
    assert providers.reply_lines("Here you go\n1. a\n2. b\nNote: done", 2) == ["a", "b"]
    assert providers.reply_lines("x\ny\nz", 2) == ["y", "z"]
    with pytest.raises(providers.ProviderError):
        providers.reply_lines("a", 2)


def test_device_providers():
    assert providers.chunks("ab\\Ncd\nlonger line here", 8) == ["ab\ncd", "longer l", "ine here"]
    device = providers.DeviceProvider(str.upper)
    assert device(["a" * 40, "b"], [[]] * 2, [[]] * 2) == ["A" * 30 + "\n" + "A" * 10, "B"] and device.estimate(["a" * 40])["note"].startswith("1 requests, about 2 calls")
    batch = providers.BatchDeviceProvider(lambda rows: [(k, t[::-1]) for k, t in reversed(rows)], size=2)
    assert batch(["ab", "cd", "ef"], [], []) == ["ba", "dc", "fe"]
    with pytest.raises(providers.ProviderError):
        providers.BatchDeviceProvider(lambda rows: rows[1:])(["a", "b"], [], [])
    with pytest.raises(ValueError):
        providers.BatchDeviceProvider(list, available=lambda: False).validate()


def test_pacer():
    now, slept = [0.0], []
    pacer = providers.Pacer(2.0, clock=lambda: now[0], sleep=lambda s: slept.append(s))
    for _ in range(3):
        pacer.wait()
    assert slept == [0.5, 1.0]


def test_registry(spark):
    translate.register("twice", lambda texts, before, after: [t + t for t in texts])
    assert translate.names() == sorted(translate.names()) and "twice" in translate.names()
    cues = spark.createDataFrame([(1, 0, "a"), (1, 1, "b\\Nc"), (2, 0, "")], "media_id bigint, seq bigint, text string")
    assert sorted(r.raw_translated for r in translate.translate(cues, "twice").collect()) == ["", "aa", "bb\\Ncc"]
    with pytest.raises(ValueError):
        translate.provider("none")


class Decoder:
    def frame(self, video, at_s, exact):
        if exact and at_s > 0.5 or video == "gone":
            raise OSError("no such time")
        return f"{video} {at_s:.1f} {exact}".encode()


class Reader:
    def recognize(self, image, languages):
        return [{"text": f" {image.decode()} {'+'.join(languages)} ", "x": 0.1, "y": 0.2, "w": 0.3, "h": 0.4}, {"text": "  ", "x": 0.0, "y": 0.0, "w": 0.0, "h": 0.0}]


class Speech:
    def transcribe(self, audio, locale):
        return [{"text": f"{audio} {locale}", "runs": [{"text": "hi", "start_s": 1.0, "duration_s": 0.5}]}]


@contextlib.contextmanager
def export(path):
    yield f"{path}.m4a"


def test_scans(spark):
    media = spark.createDataFrame([(1, "v")], "media_id bigint, path string")
    grid = spark.createDataFrame([(1, "v", 0, 0.0), (1, "v", 1, 1.0)], "media_id bigint, path string, frame bigint, sample_s double")
    got = providers.scan_texts(grid, Decoder(), Reader(), "ko-KR").orderBy("index").collect()
    assert [[o.text for o in r.observations] for r in got] == [["v 0.0 True ko-KR+en-US"], ["v 1.0 False ko-KR+en-US"]]
    assert providers.languages("en-GB") == ["en-GB"]
    spoken = providers.scan_speech(media, export, Speech(), "en").first()
    assert spoken.text == "v.m4a en" and spoken.runs[0].start_s == 1.0
    with pytest.raises(OSError, match="no frame of gone"):
        providers.decode_frame(Decoder(), "gone", 0.0)
    shown = frames.rederive(got and providers.scan_texts(grid, Decoder(), Reader(), "en"), 1, 720, profile("unfiltered")).collect()
    assert [(r.frame, r.text) for r in shown] == [(0, "v 0.0 True en")]


def test_settings():
    assert setting("model", None, {"M": "x"}, "M", "d") == "x" and setting("model", "y", {"M": "x"}, "M") == "y" and setting("model", None, {"M": ""}, "M", "d") == "d"
    with pytest.raises(ValueError):
        setting("key", None, {}, "KEY", needed=True)


def test_manifest(spark, tmp_path):
    path = tmp_path / "in.bin"
    path.write_bytes(b"12345")
    mark = fingerprint(spark, str(path))
    assert mark["size"] == 5 and workspace("r/", mark).startswith("r/") and workspace("r", mark) == workspace("r/", mark)
    made = []

    def create():
        made.append(1)
        return spark.createDataFrame([(1, 1, 0, 10, "a", "a", [])], "media_id bigint, seq bigint, start_ms bigint, end_ms bigint, raw_text string, plain_text string, attributes array<struct<key:string,value:string>>")

    root = str(tmp_path / "w")
    key = key_of("speech", locale="en")
    store = StageStore(spark, root, mark=mark)
    assert store.load("speech") is None and store.load_or_create("speech", key, create).count() == 1 and store.reusable("speech", key)
    store.load_or_create("speech", key, create)
    assert len(made) == 1 and not StageStore(spark, root, mark={**mark, "size": 6}).reusable("speech", key)
    store.delete(f"{root}/speech.cues")
    assert not store.reusable("speech", key) and store.load_or_create("speech", key, create).count() == 1 and len(made) == 2
    store.mark("speech", "running", "k2", metadata={"a": "b"}, reset=("cues",))
    assert not store.exists(f"{root}/speech.cues") and store.state("speech")["metadata"] == {"a": "b"}
    store.mark("speech", "failed", "k2", "broken")
    assert store.state("speech")["error"] == "broken" and store.state("speech")["metadata"] == {"a": "b"}
    frames_ = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 5, "z")], "media_id bigint, index bigint, text string")
    store.append_frames(frames_, "f", 3)
    assert store.state("frames")["metadata"] == {"frames": "3", "completed": "2"} and store.state("frames")["state"] == "running"
    assert key_of("merge", speech="a", texts="b", locale="en") != key_of("merge", speech="a", texts="b", locale="ko")


def test_resumption(spark):
    schema = "media_id bigint, index bigint, written bigint, fingerprint binary, observations array<string>"
    records = spark.createDataFrame([(1, 0, 1, b"a", ["x"]), (1, 1, 2, b"b", ["y"]), (1, 3, 3, b"c", ["z"])], schema)
    point = resume_point(records).first()
    assert (point.next_index, bytes(point.fingerprint), point.observations) == (2, b"b", ["y"])
    grid = spark.createDataFrame([(m, f) for m in (1, 2) for f in range(4)], "media_id bigint, frame bigint")
    assert sorted((r.media_id, r.frame) for r in remaining(grid, records).collect()) == [(1, 2), (1, 3)] + [(2, f) for f in range(4)]
    seen, told = progress(grid, 5)
    seen.collect()
    assert told() == "5/5"


def test_streamed_pause_segments(spark, tmp_path):
    rows = [(m, s, s * 100 + 500 * (s > 3), s * 100 + 500 * (s > 3) + 50, f"w{s}") for m in (1, 2) for s in range(8)]
    path = str(tmp_path / "in")
    pd.DataFrame(rows, columns=["media_id", "seq", "start_ms", "end_ms", "text"]).to_json(f"{tmp_path}/rows.json", orient="records", lines=True)
    spark.read.schema("media_id bigint, seq bigint, start_ms bigint, end_ms bigint, text string").json(f"{tmp_path}/rows.json").write.json(path)
    stream = spark.readStream.schema("media_id bigint, seq bigint, start_ms bigint, end_ms bigint, text string").json(path)
    out = pause_segments(stream, 400).writeStream.format("memory").queryName("segments").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    out.awaitTermination()
    got = {(r.media_id, r.seq): r.segment for r in spark.table("segments").collect()}
    assert got == {(m, s): 1 + (s > 3) for m in (1, 2) for s in range(8)}
