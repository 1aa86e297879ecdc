"""Providers: what recognises speech and text, decodes frames and translates stays outside, behind these interfaces.

A translation provider is a callable (texts, before, after) -> texts with an id, a name, validate() and
estimate(); it is resolved on the driver and sent to the executors whole, so it must pickle.  Recognisers take one
medium or frame and give rows; scans run them on the executors, partition by partition.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

CHARS, CHUNK = 4000, 30


class ProviderError(ValueError):
    """A reply that cannot be used; the batch is tried again in halves."""


class SpeechProvider(Protocol):
    """Recognises a medium: results of (text, runs of text, start_s, duration_s)."""

    def transcribe(self, audio: str, locale: str) -> Iterable[dict]: ...


class TextProvider(Protocol):
    """Recognises the text of a frame: observations of (text, x, y, w, h), best reading first, if there are several."""

    def recognize(self, image: bytes, languages: list[str]) -> Iterable[dict]: ...


class FrameDecoder(Protocol):
    """The frame of a video at a time; exact says whether a neighbour will do."""

    def frame(self, video: str, at_s: float, exact: bool) -> bytes: ...


class AudioExporter(Protocol):
    """A temporary audio file of a video, as a context manager that deletes it."""

    def __call__(self, video: str): ...


def decode_frame(decoder: FrameDecoder, video: str, at_s: float) -> bytes:
    """The exact frame, else a near one; an error names the video and the time."""
    try:
        return decoder.frame(video, at_s, True)
    except OSError:
        try:
            return decoder.frame(video, at_s, False)
        except OSError as e:
            raise OSError(f"no frame of {video} at {at_s:.3f} s: {e}") from e


def languages(locale: str) -> list[str]:
    """Languages that a recogniser is asked for: the locale's, and English beside any other."""
    return [locale] if locale.startswith("en") else [locale, "en-US"]


RESULTS = "media_id bigint, result bigint, text string, runs array<struct<text:string,start_s:double,duration_s:double>>"


def scan_speech(media: DataFrame, export: AudioExporter, provider: SpeechProvider, locale: str) -> DataFrame:
    """Recognition results of media (media_id, path), for word_cues."""

    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples():
                with export(row.path) as audio:
                    got = list(provider.transcribe(audio, locale))
                yield pd.DataFrame([(row.media_id, k, r["text"], r["runs"]) for k, r in enumerate(got)], columns=["media_id", "result", "text", "runs"])

    return media.select("media_id", "path").mapInPandas(run, RESULTS)


OBSERVED = "media_id bigint, index bigint, sample_s double, observations array<struct<text:string,x:double,y:double,w:double,h:double>>"


def scan_texts(grid: DataFrame, decoder: FrameDecoder, provider: TextProvider, locale: str, concurrent: int = 4) -> DataFrame:
    """Raw observations of the frames of a grid (media_id, path, frame, sample_s); concurrent frames a task, in order."""

    def one(row):
        got = provider.recognize(decode_frame(decoder, row.path, row.sample_s), languages(locale))
        kept = [{**o, "text": o["text"].strip()} for o in got if o["text"].strip()]
        return row.media_id, row.frame, row.sample_s, kept

    def run(frames):
        with ThreadPoolExecutor(concurrent) as pool:
            for pdf in frames:
                yield pd.DataFrame(list(pool.map(one, pdf.itertuples())), columns=["media_id", "index", "sample_s", "observations"])

    return grid.select("media_id", "path", "frame", "sample_s").mapInPandas(run, OBSERVED)


@dataclass
class Pacer:
    """Spaces the starts of calls; a task has its share of the whole rate, as nothing paces a cluster as one."""

    per_second: float = 1.5
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _next: float = field(default=0.0, init=False)

    def wait(self) -> None:
        now = self.clock()
        if now < self._next:
            self.sleep(self._next - now)
        self._next = max(now, self._next) + 1 / self.per_second


def batch_line(text: str) -> str:
    """One line for a batch: capped, newlines as slashes."""
    return text[:CHARS].replace("\r\n", "\n").replace("\r", "\n").replace("\n", " / ").strip()


def reply_lines(reply: str, expected: int) -> list[str]:
    """The lines of a reply without blanks, a fence, numbers and, of what is too much, commentary; an error if there are too few."""
    from ..functions.text import COMMENTARY

    lines = [x.strip() for x in reply.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()]
    if len(lines) >= 3 and lines[0].startswith("```") and lines[-1].startswith("```"):
        lines = lines[1:-1]
    lines = [re.sub(r"^\d+[.)] ", "", x) for x in lines]
    for end in (0, -1):
        while len(lines) > expected and lines[end].lower().startswith(COMMENTARY):
            del lines[end]
    if len(lines) < expected:
        raise ProviderError(f"{len(lines)} lines for {expected}")
    return lines[len(lines) - expected :]


def prompt(target: str, single: bool = False) -> str:
    """What a model is told: to translate numbered lines one by one, or a single text."""
    name = "English" if target.split("-")[0].lower() == "en" else target
    nouns = "Translate common nouns, roles and titles by meaning, not by sound; keep personal names and brands as they are usual in the target language."
    if single:
        return f"Translate the text into {name}. Use context only to understand it. {nouns} Return the translation alone."
    return f"Translate each numbered line into {name}. Return exactly one line for each, with its number. Never merge, split or skip lines, and add nothing. {nouns}"


@dataclass
class ChatProvider:
    """Translation by a chat-completions service.

    send(url, headers, body) makes the request and gives (status, reply); it is the caller's, so this library opens no
    connection itself.  Lines go in numbered batches; a reply that cannot be used is tried again in halves, a single
    line with a prompt of its own."""

    send: Callable[[str, dict[str, str], str], tuple[int, str]]
    key: str
    model: str
    base_url: str = "http://localhost"
    target: str = "en"
    header: str = "Authorization"
    most_items: int = 200
    most_chars: int = 200_000
    depth: int = 3
    concurrent: int = 10
    per_second: float = 1.5
    id: str = "chat"
    display_name: str = "Chat completions"

    def validate(self) -> None:
        if not self.key:
            raise ValueError("a key is needed")
        if self.header not in ("Authorization", "x-api-key"):
            raise ValueError(f"unknown header {self.header!r}")

    def estimate(self, texts: list[str]) -> dict:
        return {"usd": None if texts else 0.0, "note": f"{len(texts)} requests, billed by their replies" if texts else "nothing to translate"}

    def _ask(self, system: str, user: str) -> str:
        low = self.model.lower()
        body: dict = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "", user)}]}
        if not low.startswith("gpt-5"):
            body["temperature"] = 0.3
        else:
            body["reasoning_effort"] = "none" if low.startswith("gpt-5.4") else "low"
        key = f"Bearer {self.key}" if self.header == "Authorization" else self.key
        status, reply = self.send(f"{self.base_url.rstrip('/')}/v1/chat/completions", {self.header: key, "Content-Type": "application/json"}, json.dumps(body))
        if not 200 <= status < 300:
            raise OSError(f"status {status}: {reply[:200]}")
        content = json.loads(reply)["choices"][0]["message"]["content"]
        if isinstance(content, list):
            content = "".join(p.get("text") or p.get("content") or "" for p in content)
        if not (content or "").strip():
            raise ProviderError("empty reply")
        return content

    def _single(self, text: str, before: list[str], after: list[str]) -> str:
        parts = [f"Context before:\n\n{chr(10).join(before)}"] if before else []
        parts += [f"Text:\n\n{text[:CHARS]}"] + ([f"Context after:\n\n{chr(10).join(after)}"] if after else [])
        return self._ask(prompt(self.target, True), "\n\n".join(parts)).strip()

    def _batch(self, rows: list[tuple[str, list, list]], left: int) -> list[str]:
        try:
            user = "\n".join(f"{k}. {batch_line(t)}" for k, (t, _, _) in enumerate(rows, 1))
            return reply_lines(self._ask(prompt(self.target), user), len(rows))
        except ProviderError:
            if len(rows) == 1:
                return [self._single(*rows[0])]
            if left <= 0:
                raise
        m = len(rows) // 2
        return self._batch(rows[:m], left - 1) + self._batch(rows[m:], left - 1)

    def packed(self, rows: list[tuple[str, list, list]]) -> list[list[tuple[str, list, list]]]:
        """Rows in batches that are closed when full, or when the next row would make them too large."""
        out, size = [], 0
        for text, before, after in rows:
            cost = min(len(text), CHARS) + len("\n".join(before)) + len("\n".join(after)) + 128
            if not out or len(out[-1]) >= self.most_items or size + cost > self.most_chars:
                out.append([])
                size = 0
            out[-1].append((text, before, after))
            size += cost
        return out

    def __call__(self, texts: list[str], before: list[list[str]], after: list[list[str]]) -> list[str]:
        self.validate()
        rows = [(t, list(b), list(a)) for t, b, a in zip(texts, before, after, strict=True)]
        asked = [k for k, r in enumerate(rows) if r[0].strip()]  # a blank line needs no model
        pacer = Pacer(self.per_second)

        def begin(batch):
            pacer.wait()
            return pool.submit(self._batch, batch, self.depth)

        with ThreadPoolExecutor(self.concurrent) as pool:
            done = [x for f in [begin(b) for b in self.packed([rows[k] for k in asked])] for x in f.result()]
        out = list(texts)
        for k, x in zip(asked, done, strict=True):
            out[k] = x
        return out


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """Lines of a text packed into chunks of at most size characters; an overlong line is cut hard."""
    out, now = [], ""
    for line in text.replace("\\N", "\n").split("\n"):
        joined = f"{now}\n{line}" if now else line
        if len(joined) <= size:
            now = joined
            continue
        out += [now] if now else []
        now = line if len(line) <= size else ""
        if not now:
            out += [line[k : k + size] for k in range(0, max(1, len(line)), size)]
    return out + ([now] if now else [])


@dataclass
class DeviceProvider:
    """Translation by a model on the machine, chunk by chunk: call(chunk) gives its translation."""

    call: Callable[[str], str]
    concurrent: int = 4
    id: str = "device"
    display_name: str = "On-device model"

    def validate(self) -> None:
        if not callable(self.call):
            raise ValueError("call must be callable")

    def estimate(self, texts: list[str]) -> dict:
        calls = sum(len(chunks(t)) for t in texts)
        return {"usd": 0.0, "note": f"{len(texts)} requests, about {calls} calls on the device" if texts else "nothing to translate"}

    def __call__(self, texts: list[str], before: list[list[str]], after: list[list[str]]) -> list[str]:
        with ThreadPoolExecutor(self.concurrent) as pool:
            return ["\n".join(x.strip() for x in pool.map(self.call, chunks(t))) for t in texts]


@dataclass
class BatchDeviceProvider:
    """Translation by a service on the machine in batches: call([(id, text)]) gives (id, text) in any order."""

    call: Callable[[list[tuple[int, str]]], list[tuple[int, str]]]
    available: Callable[[], bool] = lambda: True
    size: int = 50
    id: str = "device-batch"
    display_name: str = "On-device translation"

    def validate(self) -> None:
        if not self.available():
            raise ValueError("the languages are not installed")

    def estimate(self, texts: list[str]) -> dict:
        return {"usd": 0.0, "note": f"{len(texts)} requests, about {-(-len(texts) // self.size)} calls on the device" if texts else "nothing to translate"}

    def __call__(self, texts: list[str], before: list[list[str]], after: list[list[str]]) -> list[str]:
        self.validate()
        got = {k: t for lo in range(0, len(texts), self.size) for k, t in self.call(list(enumerate(texts))[lo : lo + self.size])}
        if set(got) != set(range(len(texts))):  # a client id that is unknown or lacks a text
            raise ProviderError("replies do not match the requests")
        return [got[k] for k in range(len(texts))]
