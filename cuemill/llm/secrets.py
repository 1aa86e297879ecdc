"""Secret scans: three fixed kinds, and random strings exposed by token efficiency.

A vocabulary learnt on text spends few tokens on what looks like text and many on random strings.
A long run of identifier characters whose characters per token fall below a threshold is reported
as ``random``, unless it is a known digest, an identifier, or already part of a span of a fixed kind.
Identifiers are UUIDs, numbers and dates (one letter at most), and runs whose words, by themselves and in lower
case, are as cheap in tokens as text is; whether a run holds digits, letters or both makes no other difference.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import text_of

KINDS = ("assign", "access", "hex", "random")
# Fixed values.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
LEAST = {"assign": 12, "access": 18, "random": 20}
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
PARTS = re.compile("[A-Z]?[a-z]+|[A-Z]+")
#: Characters that are encoded at a time.
PIECE = 1000
_encodings: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoding(path: str):
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        _encodings[path] = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed kinds; a match that fails its check is dropped without a retry."""
    out = []
    low = text.lower() if ":" in text or "=" in text else ""
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _efficiency(texts: list[str], encode) -> float:
    """Characters per token of some texts, long ones in pieces."""
    pieces = [t[k : k + PIECE] for t in texts for k in range(0, len(t), PIECE)]
    return sum(map(len, pieces)) / max(1, sum(len(encode(p)) for p in pieces))


def _excluded(run: str, ratio: float, encode) -> bool:
    """Whether a run is a known digest or an identifier."""
    if len(run) in DIGEST_LENGTHS and re.fullmatch("[0-9a-f]+|[0-9A-F]+", run) or UUID.fullmatch(run):
        return True
    parts = PARTS.findall(run)
    return sum(map(len, parts)) < 2 or _efficiency([p.lower() for p in parts], encode) >= ratio


def random_spans(text: str, base: list[tuple[int, int, int]], ratio: float, encode) -> list[tuple[int, int, int]]:
    """Spans of the runs outside base (sorted) with fewer than ratio characters per token."""
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))
    out = []
    for m in RUN.finditer(text):
        before = bisect_left(starts, m.end())
        if before and reach[before - 1] > m.start():
            continue
        if _efficiency([m.group()], encode) < ratio and not _excluded(m.group(), ratio, encode):
            out.append((m.start(), 3, m.end()))
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(path: str, ratio: float):
    def run(batches):
        encode = _encoding(path).encode_ordinary
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                out = [[] for _ in range(5)]
                for text in b.column(1).slice(lo, 512).to_pylist():
                    base = base_spans(text)
                    row = [sum(k == n for _, k, _ in base) for n in range(3)]
                    row += [hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + random_spans(text, base, ratio, encode)))]
                    for o, v in zip(out, row, strict=True):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 512), *[pa.array(o, pa.int64()) for o in out[:3]], *[pa.array(o, pa.string()) for o in out[3:]]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def find_secrets(docs: DataFrame, vocabulary: str | None = None, ratio: float = 2.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in whole texts, in code points with exclusive ends.

    Returns doc_id, n_assign, n_access, n_hex (fixed kinds), base_sha256 (of their kind:start:end)
    and spans (all kinds).  A span covers its whole match.  Null text is empty and has no spans;
    repeated rows and null ids stay, an empty table gives an empty table, and other columns are
    ignored, whatever their names.  Nothing is shuffled.
    """
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(_scan(vocabulary or default_vocabulary(), ratio), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
