"""Substring dedup with a count-min prefilter.

A window is a run of consecutive words.  Each window is represented by its least gram (a shorter run
inside it), so equal windows have equal representatives and neighbouring windows share them; that cuts
what must be counted to about a thirteenth.  Every task adds the representatives of its documents to a
count-min sketch, sent as its touched cells; the partial sketches are merged chunk by chunk into one
bit set (estimate two or more), which is all that is broadcast.  Its size follows from the number of bytes of
text, 256 MB at most.  A sketch only overestimates, so the second pass, which groups exactly the windows with a
repeated representative, loses none.  When a corpus outgrows the largest sketch, more windows pass;
the result stays the same.

Before windows are shuffled each task settles what it can by itself: of equal windows in a batch
only those of the smallest document go on, so a passage that many documents share is sent once a batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._core import mix, runs, staged, text_of, word_blocks
from ._stats import _repeats

U = np.uint64
ROWS = 2
CHUNK_BITS = 19
ROW_KEYS = mix(np.arange(1, ROWS + 1, dtype=U))
#: Cells of a row of the sketch as a power of two, at least and at most; and cells for each representative.
LEAST_BITS, MOST_BITS = 20, 30
CELLS_EACH = 8
#: Bytes of a word and the blank after it, about.
WORD_BYTES = 6


def row_bits(n_bytes: int, width: int, gram: int) -> int:
    """Cells of a row, as a power of two, for so many bytes of text: one representative is had every (width - gram) / 2 words."""
    expected = n_bytes / WORD_BYTES / max(1, (width - gram) / 2)
    return int(np.clip(np.ceil(np.log2(max(1, CELLS_EACH * expected))), LEAST_BITS, MOST_BITS))


def _least(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each span consecutive values."""
    if len(x) < span:
        return x[:0]
    have = 1
    while have < span:
        more = min(have, span - have)
        x = np.minimum(x[: len(x) - more], x[more:])
        have += more
    return x


def windows(words, width: int, gram: int):
    """(row, first word in the row, hash, representative) of the windows of each row."""
    h = words.hashes()
    whole = runs(h, width)
    rep = _least(runs(h, gram), width - gram + 1)
    count = np.maximum(words.count - width + 1, 0)
    at = np.concatenate(([0], np.cumsum(count)))
    pos = np.arange(at[-1]) - np.repeat(at[:-1], count)
    first = np.repeat(words.rows[:-1], count) + pos
    return np.repeat(np.arange(len(count)), count), pos, whole[first], rep[first]


def cells(rep: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each representative in each row of the sketch."""
    return np.stack([(mix(rep ^ ROW_KEYS[k]) >> U(64 - bits)).astype(np.int64) + (k << bits) for k in range(ROWS)])


def _sketch(width: int, gram: int, bits: int):
    n_chunks = ROWS << (bits - CHUNK_BITS)

    def run(batches):
        for b in batches:
            reps = []
            for _, _, words in word_blocks(b.column(0)):
                row, _, _, rep = windows(words, width, gram)
                fresh = np.ones(len(rep), bool)
                fresh[1:] = (rep[1:] != rep[:-1]) | (row[1:] != row[:-1])
                row, rep = row[fresh], rep[fresh]
                reps.append(rep[~_repeats(rep, row)[1]])
            every = cells(np.concatenate(reps), bits) if reps else np.zeros((ROWS, 0), np.int64)
            cell, count = np.unique(every.ravel(), return_counts=True)
            chunk = cell >> CHUNK_BITS
            bounds = np.searchsorted(chunk, np.arange(n_chunks + 1))
            packed = ((cell & ((1 << CHUNK_BITS) - 1)) * 2 + (count > 1)).astype(np.uint32)
            used = np.flatnonzero(np.diff(bounds))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([packed[bounds[k] : bounds[k + 1]].tobytes() for k in used], pa.binary())], ["chunk", "cells"])

    return run


def _merge(batches):
    now, count = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(count > 1).tobytes()], pa.binary())], ["chunk", "bits"])

    for b in batches:
        for chunk, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if chunk != now:
                if now is not None:
                    yield done()
                now, count = chunk, np.zeros(1 << CHUNK_BITS, np.uint8)
            packed = np.frombuffer(part.as_buffer(), np.uint32)
            at = packed >> 1
            count[at] = np.minimum(count[at] + 1 + (packed & 1), 2)
    if now is not None:
        yield done()


def sketch(texts: DataFrame, width: int, gram: int, bits: int) -> np.ndarray:
    """The merged sketch as a bit set of ROWS * 2**bits bits."""
    parts = texts.mapInArrow(_sketch(width, gram, bits), "chunk int, cells binary")
    merged = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_merge, "chunk int, bits binary")
    out = np.zeros((ROWS << (bits - CHUNK_BITS), 1 << (CHUNK_BITS - 3)), np.uint8)
    for r in merged.toLocalIterator():
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


_OUT = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])


def _spread(width: int, gram: int, bits: int, shared):
    def run(batches):
        marked = shared.value
        for b in batches:
            ids, keys = (b.column(k).to_numpy() for k in (0, 1))
            found = []
            for lo, _, words in word_blocks(b.column(2)):
                row, pos, whole, rep = windows(words, width, gram)
                where = cells(rep, bits)
                hit = np.ones(len(rep), bool)
                for c in where:
                    hit &= (marked[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 > 0
                found.append((row[hit] + lo, pos[hit], whole[hit]))
            if not found:
                continue
            row, pos, whole = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.lexsort((ids[row], whole))
            row, pos, whole = row[by], pos[by], whole[by]
            start = np.ones(len(whole), bool)
            start[1:] = whole[1:] != whole[:-1]
            least = ids[row][np.maximum.accumulate(np.where(start, np.arange(len(whole)), 0))]
            known = ids[row] > least
            # settled here: runs of neighbouring windows of one row become one range
            r, p = row[known], pos[known]
            by = np.lexsort((p, r))
            r, p = r[by], p[by]
            cut = np.ones(len(r), bool)
            cut[1:] = (r[1:] != r[:-1]) | (p[1:] > p[:-1] + width)
            first = np.flatnonzero(cut)
            last = np.append(first[1:], len(r)) - 1 if len(first) else first
            n = len(first)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(ids[r[first]]), pa.array(keys[r[first]]), pa.array(p[first], pa.int32()), pa.array(p[last] + width, pa.int32())], schema=_OUT)
            r, p, w = row[~known], pos[~known], whole[~known]
            for a in range(0, len(r), 200_000):
                z = slice(a, a + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(w[z].view(np.int64)), pa.array(ids[r[z]]), pa.array(keys[r[z]]), pa.array(p[z], pa.int32()), pa.array(p[z] + width, pa.int32())], schema=_OUT)

    return run


def _keep(batches):
    for b in batches:
        text = b.column(1).cast(pa.large_binary()).to_pylist()
        spans = b.column(2)
        out = ([], [], [], [])
        for i, (t, span) in enumerate(zip(text, spans, strict=True)):
            words = t.split()
            n = len(words)
            if span.is_valid:
                edge = np.zeros(n + 1, np.int64)
                got = span.values
                np.add.at(edge, got.field(0).to_numpy(), 1)
                np.add.at(edge, got.field(1).to_numpy(), -1)
                left = np.flatnonzero(np.cumsum(edge[:n]) == 0)
                words = [words[k] for k in left]
            kept = b" ".join(words)
            for o, v in zip(out, (n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()), strict=True):
                o.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_repeated(docs: DataFrame, width: int = 50, gram: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a window that also starts in a document with a smaller id.

    Words are runs outside white space, compared unchanged; windows of ``width`` words lie in one
    document and are judged on the input.  Returns doc_id, n_words, n_removed, kept_sha256 and kept
    (the words left, joined by one space), one row per input row.

    Null text is empty.  A row with a null id is no smaller and no larger than any other: it removes
    nothing and loses nothing.  Repeated rows with one id do not remove each other.  Texts shorter
    than a window stay.  An empty table gives an empty table; other columns are ignored, whatever
    their names.  Windows are told apart by 64-bit hashes of their words.
    """
    gram = gram or (width + 1) // 2
    spark = docs.sparkSession
    text = text_of(docs, text_col)
    ident = docs[id_col].cast("bigint")
    rows = docs.select(ident.alias("doc_id"), F.xxhash64(ident, text).alias("key"), text.alias("text"))
    numbered = rows.where("doc_id is not null")
    bits = row_bits(numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0, width, gram)
    shared = spark.sparkContext.broadcast(sketch(numbered.select("text"), width, gram, bits))
    found = staged(numbered.mapInArrow(_spread(width, gram, bits, shared), "h bigint, doc_id bigint, key bigint, s int, e int"), "substring-windows")
    least = F.min("doc_id").over(W.partitionBy("h"))
    later = found.where("h is not null").withColumn("least", least).where("least < doc_id").select("key", "s", "e")
    ranges = found.where("h is null").select("key", "s", "e").unionAll(later).groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    joined = rows.join(ranges, F.col("key") == F.col("k"), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_keep, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL),
h AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM p),
m AS (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY k) AS least FROM h),
c AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS q FROM m WHERE least < doc_id),
u AS (SELECT r, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS q FROM d),
x AS (SELECT u.r, v, u.q, c.q IS NOT NULL AS dead FROM u LEFT JOIN c ON c.r = u.r AND c.q = u.q),
k AS (SELECT r, string_agg(v, ' ' ORDER BY q) FILTER (WHERE NOT dead) AS kept, count(*) FILTER (WHERE dead) AS n_removed FROM x GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.r = d.r
"""
