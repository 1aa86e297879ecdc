"""Token counts through a digest cache.

A text is looked up by its SHA-256 and the digest of the tokenizer's file.  Only distinct texts that the
cache lacks are encoded, and their counts are appended to it, each run's in a folder of its own, so that runs
beside one another do no harm.  Digests that many rows share are looked up without a task for each.

Encoding counts tokens per piece of text: byte-level pre-tokenization never joins across the place
between a character that is no white space and a single blank or newline that another such character
follows, so a text's count is the sum over its pieces.  A worker encodes a piece that it has not met;
it knows pieces by their bytes.  Texts are cut only where the neighbours are visible ASCII or Latin
letters, and where a common mark follows an ASCII letter; elsewhere pieces are just longer.
Should the tokenizer's file call for anything else (a prefix blank, a normalizer), whole texts are encoded.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._core import blocks, buffers, join_split, lasting_dir, span_hashes, staged, text_of

MEMORY = 1_000_000
#: Marks that a run of letters ends at in any case; the apostrophe is none, as it starts contractions.
_MARK = np.isin(np.arange(256), list(b",.!?;:%#$*&"))
_loaded: dict[str, tuple] = {}
_known: dict[str, dict[bytes, int]] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _separable(path: str) -> bool:
    """Whether counts add up over pieces: plain byte-level BPE, and special strings without blanks."""
    conf = json.loads(open(path, encoding="utf-8").read())
    pre = conf.get("pre_tokenizer") or {}
    added = conf.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    return bool(plain) and conf.get("normalizer") is None and not any(re.search(r"\s|[A-Za-z][,.!?;:%#$*&]", a["content"]) or a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in added)


def _library(path: str):
    """A function from a list of texts to their numbers of tokens, and whether counts add up over pieces."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False)
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _loaded[path] = (lambda texts: [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)], _separable(path))
    return _loaded[path]


def _pieces(raw: np.ndarray, offsets: np.ndarray):
    """(first byte, end byte, row) of the pieces of some rows."""
    n = len(raw)
    cut = np.zeros(n, bool)
    if n > 2:
        latin = (raw >= 0xC3) & (raw <= 0xC5)
        seen = (raw > 0x20) & (raw < 0x7F)
        before = seen.copy()
        before[1:] |= latin[:-1] & (raw[1:] >= 0x80)
        cut[1:-1] = ((raw[1:-1] == 0x20) | (raw[1:-1] == 0x0A)) & before[:-2] & (seen | latin)[2:]
        letter = ((raw | 0x20) >= 97) & ((raw | 0x20) <= 122)
        cut[1:] |= _MARK[raw[1:]] & letter[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    cut[edges] = True
    last = edges[edges > 0] - 1
    cut[last[~np.isin(last, edges) & ((raw[last] == 0x20) | (raw[last] == 0x0A))]] = False  # no neighbour in its row
    start = np.flatnonzero(cut)
    row = np.searchsorted(offsets, start, "right") - 1
    return start, np.append(start[1:], n), row


def counts_of(column: pa.Array, path: str) -> np.ndarray:
    """Tokens of each row of a string column."""
    whole, separable = _library(path)
    if not separable:
        return np.array([n for lo in range(0, len(column), 256) for n in whole(column.slice(lo, 256).to_pylist())], np.int64)
    known = _known.setdefault(path, {})
    raw, offsets = buffers(column)
    out = np.zeros(len(column), np.int64)
    for lo, hi in blocks(offsets):
        part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        start, end, row = _pieces(part, at)
        _, first, inverse = np.unique(span_hashes(part, start, end), return_index=True, return_inverse=True)
        data = part.tobytes()
        keys = [data[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        if len(known) + len(keys) > MEMORY:
            known.clear()
        new = [k for k in keys if k not in known]
        for a in range(0, len(new), 1000):
            some = new[a : a + 1000]
            known.update(zip(some, whole([k.decode() for k in some]), strict=True))
        tokens = np.array([known[k] for k in keys], np.int64)
        out[lo:hi] = np.bincount(row, tokens[inverse], hi - lo).astype(np.int64)
    return out


def _encode(path: str):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts_of(b.column(1), path))], ["digest", "n_tokens"])

    return run


def tokenizer_version(path: str) -> str:
    return hashlib.sha256(open(path, "rb").read()).hexdigest()


SCHEMA = "digest binary, n_tokens bigint"


def _cached(spark: SparkSession, folder: str) -> DataFrame:
    """The cache of one tokenizer, which is made if there is none; digests may stand in it more than once."""
    try:
        return spark.read.schema(SCHEMA).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/run=none", mode="overwrite")
    return spark.read.schema(SCHEMA).parquet(folder)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, cache_dir: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text by a public tokenizer's own library, without special tokens added.

    ``tokenizer`` is the path of a .json (tokenizers) or .model (sentencepiece) file.  ``cache_dir``
    is a folder that all executors share, with a Parquet table of (digest, n_tokens) for each tokenizer; None
    stands for the one that lasts below spark.checkpoint.dir.  The content digested is the text itself, null as
    empty.  A run on texts that the cache has encodes nothing and shuffles no text.

    Returns doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), one row per input
    row.  Repeated rows and null ids stay, an empty text has 0 tokens, an empty table gives an empty
    table; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    folder = f"{(cache_dir or lasting_dir(spark, 'token-cache')).rstrip('/')}/{tokenizer_version(tokenizer)}"
    text = text_of(docs, text_col)
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), digest.alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    rows = staged(rows, "token-rows")
    missing = staged(rows.select("digest").distinct().join(_cached(spark, folder).select("digest"), "digest", "left_anti"), "token-misses")
    if not missing.isEmpty():
        contents = docs.select(digest.alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
        made = contents.join(missing, "digest", "left_semi").mapInArrow(_encode(tokenizer), SCHEMA)
        made.write.parquet(f"{folder}/run={uuid.uuid4().hex}")
    counts = _cached(spark, folder).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    return join_split(rows, counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
