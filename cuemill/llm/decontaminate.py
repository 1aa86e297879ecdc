"""Benchmark decontamination by latent semantic retrieval.

The queries are the benchmark's items, in blocks of bounded vocabulary; the searched rows are all documents.
An item longer than ``SECTION`` words is cut into sections, each found by itself, so items may have any length.
For a block, a document is cut into segments of ``SEGMENT`` words, and its words are numbered by the block's
vocabulary (words outside it carry no weight in any product with an item).  Word frequencies, and a
single-pass randomised SVD of the TF-IDF matrix of all segments, are sums over partitions of arrays
whose size depends on the vocabulary and the rank only; they are added up piece by piece in many tasks.  Two
neighbouring segments are a passage.  Sections and passages whose cosine in the latent space reaches a threshold
are candidates; a section much longer than a passage is also looked up by its parts of a passage's length, any of
which makes a candidate.  A candidate is confirmed by the longest common subsequence of the section's words with the
passage and its surroundings; a document holds an item if the sections found cover enough of the item's
words, and if the same test holds for the item's answer, its last sentence.

Very common words carry no weight.  Sections with hardly any other words are looked up in a search of their own,
in which all words count, so that no item's result depends on the weights of others.

Words are lower-cased runs of ASCII letters and digits and of non-ASCII characters.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import LOWER, staged, text_of, word_blocks

SEGMENT = 16
#: Sections of more words are looked up by parts of two segments as well.
LONG = 4 * SEGMENT
#: Words of a section at most; longer items are cut into equal sections.
SECTION = 512
RANK = 128
#: Distinct words and words of a block at most; a single item may bring more, section by section.
BLOCK_VOCABULARY = 60_000
BLOCK_WORDS = 500_000
NONE = (1 << 32) - 1
#: Entries of a matrix of cosines and of a piece of a summed array.
TILE = 4_000_000
PIECE = 1 << 16
#: Words in more than one of so many segments carry no weight; a passage with fewer weighted words than
#: LEAST_TERMS cannot come near any section that has so many.
COMMON = 300
LEAST_TERMS = 3
RAREST = 30_000
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Block:
    """Some sections: their item, word sequence, place in the item and the item's answer, over a common vocabulary of word hashes."""

    def __init__(self, sections: list[tuple[int, int, int, np.ndarray, np.ndarray | None]]):
        self.items = [x[0] for x in sections]
        self.totals = [x[1] for x in sections]  # words of the whole item
        self.numbers = [x[2] for x in sections]
        self.vocabulary = np.unique(np.concatenate([x[3] for x in sections])) if sections else np.zeros(0, np.uint64)
        index = lambda h: np.searchsorted(self.vocabulary, h).astype(np.uint32)
        self.words = [index(x[3]) for x in sections]
        self.answers = [None if x[4] is None else index(x[4]) for x in sections]

    def part(self, which: list[int]) -> Block:
        """The same vocabulary with some of the sections."""
        out = Block([])
        out.vocabulary = self.vocabulary
        for name in ("items", "totals", "numbers", "words", "answers"):
            setattr(out, name, [getattr(self, name)[k] for k in which])
        return out


def _answer(text: str) -> str:
    """The last sentence of a text, or its last two when that one has a single word."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    return " ".join(parts[-2:] if parts and len(parts[-1].split()) < 2 else parts[-1:])


def _hashes(text: str) -> np.ndarray:
    return np.concatenate([w.hashes(LOWER) for _, _, w in word_blocks(pa.array([text], pa.string()), between=_BETWEEN)])


def sections_of(item: int, text: str) -> list[tuple[int, int, int, np.ndarray, np.ndarray | None]]:
    """(item, words of the item, number, word hashes, answer) of the sections of an item.

    The last one has the answer, as far as it lies in that section; others have none."""
    words, answer = _hashes(text), _hashes(_answer(text))
    if not len(words):
        return []
    parts = np.array_split(words, -(-len(words) // SECTION))
    answer = answer[-len(parts[-1]) :]
    return [(item, len(words), k, p, answer if k == len(parts) - 1 else None) for k, p in enumerate(parts)]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The benchmark row by row from the executors, grouped into blocks of bounded size."""
    rows, size, seen = [], 0, set()
    for r in benchmark.select(F.col(id_col).cast("bigint").alias("i"), F.lower(text_col).alias("t")).where("i is not null").toLocalIterator():
        for section in sections_of(r[0], r[1] or ""):
            new = set(section[3].tolist())
            if rows and (size + len(section[3]) > BLOCK_WORDS or len(seen | new) > BLOCK_VOCABULARY):
                yield Block(rows)
                rows, size, seen = [], 0, set()
            rows.append(section)
            size += len(section[3])
            seen |= new
    if rows:
        yield Block(rows)


_SEQ = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int32()), ("seq", pa.binary())])


def _number(vocabulary: np.ndarray):
    def run(batches):
        # a table by the leading bits refuses most words before the search
        gate = np.zeros(1 << 20, bool)
        gate[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
        for b in batches:
            for lo, hi, w in word_blocks(b.column(2), between=_BETWEEN):
                h = w.hashes(LOWER)
                near = np.flatnonzero(gate[(h >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(vocabulary, h[near]), len(vocabulary) - 1)
                seq = np.full(len(h), NONE, np.uint32)
                same = vocabulary[at] == h[near]
                seq[near[same]] = at[same]
                data = pa.py_buffer(seq.tobytes())
                packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((4 * w.rows).astype(np.int32).tobytes()), data])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(w.count, pa.int32()), packed], schema=_SEQ)

    return run


class Segments:
    """Vocabulary hits of a batch of sequences: hit k is word term[k] in segment seg[k]; rows are documents."""

    def __init__(self, n: np.ndarray, column: pa.Array, step: int, weight: np.ndarray | None = None):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 4
        data = column.buffers()[2]
        self.all = np.frombuffer(data, np.uint32, int(data.size // 4)) if data is not None else np.zeros(0, np.uint32)
        self.offsets = offsets
        count = np.maximum(-(-n // step), 0)
        self.first = np.concatenate(([0], np.cumsum(count)))
        self.doc = np.repeat(np.arange(len(n)), count)
        words = self.all[offsets[0] : offsets[-1]]
        hit = np.flatnonzero(words != NONE)
        if weight is not None:
            hit = hit[weight[words[hit]] > 0]
        self.term = words[hit].astype(np.int64)
        row = np.searchsorted(offsets - offsets[0], hit, "right") - 1
        self.seg = self.first[row] + (hit - (offsets[row] - offsets[0])) // step

    def __len__(self):
        return int(self.first[-1])


def _slices(b, rows: int = 1000):
    for lo in range(0, b.num_rows, rows):
        part = b.slice(lo, rows)
        yield lo, part, part.column(part.schema.get_field_index("n")).to_numpy()


def _frequencies(size: int):
    def run(batches):
        total = np.zeros(size + 1, np.int64)
        for b in batches:
            for _, part, n in _slices(b):
                s = Segments(n, part.column(part.schema.get_field_index("seq")), SEGMENT)
                total[:size] += np.bincount(s.term, minlength=size)
                total[size] += len(s)
        yield _pieces_of(total)

    return run


def _pieces_of(total: np.ndarray) -> pa.RecordBatch:
    """An array as numbered pieces, so that the sum over partitions is spread over tasks."""
    flat = total.ravel()
    cut = [flat[a : a + PIECE].tobytes() for a in range(0, len(flat), PIECE)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary())], ["k", "v"])


def _project(s: Segments, table: np.ndarray) -> np.ndarray:
    """Rows of the term matrix of the segments times a table that has the weights in it."""
    out = np.zeros((len(s), table.shape[1]), np.float32)
    left, start = np.arange(len(s.seg)), np.flatnonzero(np.diff(s.seg, prepend=-1))
    nth = left - start[np.searchsorted(start, left, "right") - 1] if len(start) else left
    for k in range(int(nth.max(initial=-1)) + 1):  # at most as many rounds as a segment has words
        at = np.flatnonzero(nth == k)
        out[s.seg[at]] += table[s.term[at]]
    return out


def _gram(weight: np.ndarray, omega):
    """Partial sums of A'(A Omega) for the rows of a partition; rows of A have unit length."""

    def run(batches):
        table = omega()
        scaled = table * weight[:, None]
        total = np.zeros((table.shape[1], len(weight)))
        alone = np.zeros(len(weight), np.int64)
        for b in batches:
            for _, part, n in _slices(b):
                s = Segments(n, part.column(part.schema.get_field_index("seq")), SEGMENT, weight)
                hits = np.bincount(s.seg, minlength=len(s))
                single = hits[s.seg] == 1  # such a row has one entry, 1
                alone += np.bincount(s.term[single], minlength=len(weight))
                s.seg, s.term = s.seg[~single], s.term[~single]
                if not len(s.seg):
                    continue
                w = weight[s.term]
                y = _project(s, scaled)
                g = y[s.seg] * (w / np.bincount(s.seg, w * w, len(s))[s.seg].astype(np.float32))[:, None]
                for c in range(g.shape[1]):
                    total[c] += np.bincount(s.term, g[:, c], len(weight))
        total = total.T + alone[:, None] * table
        yield _pieces_of(total.astype(np.float32))

    return run


def _summed(df: DataFrame, dtype) -> np.ndarray | None:
    """Sum of the arrays that partitions sent in pieces; the driver gets one array, whatever the number of partitions."""

    def add(batches):
        now, total = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.astype(dtype).tobytes()], pa.binary())], ["k", "v"])

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.frombuffer(x.as_buffer(), dtype)
                if k != now:
                    if now is not None:
                        yield done()
                    now, total = k, np.zeros(len(v), np.float64 if dtype == np.float32 else dtype)
                total += v
        if now is not None:
            yield done()

    rows = df.repartition("k").sortWithinPartitions("k").mapInArrow(add, "k int, v binary").toLocalIterator()
    got = {r["k"]: np.frombuffer(r["v"], dtype) for r in rows}
    return np.concatenate([got[k] for k in sorted(got)]) if got else None


def weights(counts: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Inverse-frequency weights: the root of segments per occurrence, up to RAREST, so that in the sums
    over all segments no word's energy swamps that of rarer ones; first with 0 for common words, then for all."""
    spread = (segments + 1) / (counts + 1)
    weight = np.sqrt(np.minimum(spread, RAREST)).astype(np.float32)
    return np.where(spread > COMMON, weight, np.float32(0)), weight


def latent_space(sequences: DataFrame, weight: np.ndarray, rank: int, seed: int = 11) -> np.ndarray:
    """Right singular vectors (vocabulary by rank) of the segments' TF-IDF matrix, by one randomised pass (Nystroem)."""
    size = len(weight)
    rank = min(rank, size)
    omega = lambda: np.random.Generator(np.random.PCG64(seed)).standard_normal((size, rank)).astype(np.float32)
    got = _summed(sequences.select("n", "seq").mapInArrow(_gram(weight, omega), "k int, v binary"), np.float32)
    b = got.reshape(size, rank).astype(np.float64) if got is not None else np.zeros((size, rank))
    core = omega().astype(np.float64).T @ b
    value, vector = np.linalg.eigh((core + core.T) / 2)
    keep = value > 1e-6 * max(value.max(initial=0), 1e-12)
    if not keep.any():
        return np.eye(size, rank, dtype=np.float32)
    u, s, _ = np.linalg.svd(b @ (vector[:, keep] / np.sqrt(value[keep])), full_matrices=False)
    return u[:, s > 1e-5 * s[0]].astype(np.float32)


def common_length(item: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    where: dict[int, int] = {}
    for k, t in enumerate(item.tolist()):
        where[t] = where.get(t, 0) | (1 << k)
    full = (1 << len(item)) - 1
    v = full
    for t in region.tolist():
        m = where.get(t)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _parts(block: Block, weight: np.ndarray, least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Numbers of the sections and word sequences to look up: whole sections, and the parts of long ones.

    Parts with fewer than least weighted words say little and are left to the others, if a section has others."""
    of, words = list(range(len(block.words))), list(block.words)
    for k, w in enumerate(block.words):
        if len(w) > LONG:
            starts = [*range(0, len(w) - 2 * SEGMENT, 2 * SEGMENT), len(w) - 2 * SEGMENT]
            parts = [w[a : a + 2 * SEGMENT] for a in starts]
            rich = [p for p in parts if (weight[p.astype(np.int64)] > 0).sum() >= least]
            words += rich or parts
            of += [k] * len(rich or parts)
    return np.array(of), words


HITS = "doc_id bigint, text_hash bigint, item_id bigint, total int, section int, cosine double, common int, answer double"
_HIT = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("total", pa.int32()), ("section", pa.int32()), ("cosine", pa.float64()), ("common", pa.int32()), ("answer", pa.float64())])


def _confirmed(block: Block, q: int, region: np.ndarray, common: float) -> tuple[int, float | None] | None:
    """Common words of a section and a region and the share of the answer, or None if they are too few.

    Of several sections each may be poorer than the whole item must be."""
    section = block.words[q]
    got = common_length(section, region)
    if got < (common if len(section) == block.totals[q] else common / 2) * len(section):
        return None
    last = block.answers[q]
    if last is None:
        return got, None
    return got, common_length(last, region) / len(last) if len(last) else 1.0


def _search(block: Block, weight: np.ndarray, space: np.ndarray, terms: int, cosine: float, common: float):
    """The best confirmed passage of each section in each document; a passage has at least terms weighted words."""

    def run(batches):
        table = np.ascontiguousarray(space * weight[:, None])
        of, parts = _parts(block, weight, terms)
        queries = np.stack([table[w.astype(np.int64)].sum(0) for w in parts])
        length = np.linalg.norm(queries, axis=1, keepdims=True)
        queries = (queries / np.where(length > 0, length, 1)).T.astype(np.float32)
        tile = max(1, TILE // queries.shape[1])
        for b in batches:
            found = []
            for lo, part, n in _slices(b):
                s = Segments(n, part.column(part.schema.get_field_index("seq")), SEGMENT, weight)
                if not len(s.seg):
                    continue
                y = _project(s, table)
                hits = np.bincount(s.seg, minlength=len(s))
                pair = y.copy()
                joined = s.doc[1:] == s.doc[:-1]
                pair[:-1][joined] += y[1:][joined]
                hits[:-1][joined] += hits[1:][joined]
                live = np.flatnonzero(hits >= terms)
                pair = pair[live]
                pair /= np.maximum(np.linalg.norm(pair, axis=1, keepdims=True), 1e-30)
                best: dict[tuple[int, int, int], tuple[float, int]] = {}
                for first in range(0, len(live), tile):
                    got = pair[first : first + tile] @ queries
                    for p, q in zip(*np.nonzero(got >= cosine), strict=True):
                        at_seg = live[first + p]
                        doc, k = s.doc[at_seg], of[q]
                        at = (at_seg - s.first[doc]) * SEGMENT
                        # of the passages of a long section that stand close together one is confirmed, over a wider region
                        near = at // (len(block.words[k]) // 4) if len(block.words[k]) > LONG else at
                        if (doc, k, near) not in best or best[doc, k, near][0] < got[p, q]:
                            best[doc, k, near] = (float(got[p, q]), at)
                top: dict[tuple[int, int], tuple] = {}
                for (doc, q, _), (score, at) in best.items():
                    base, end = s.offsets[doc], s.offsets[doc + 1]
                    around = len(block.words[q]) + (len(block.words[q]) // 4 if len(block.words[q]) > LONG else 0)
                    told = _confirmed(block, q, s.all[base + max(0, at - around) : min(end, base + at + 2 * SEGMENT + around)], common)
                    if told:
                        row = (told[0], -1.0 if told[1] is None else told[1], score)
                        top[doc, q] = max(top.get((doc, q), row), row)
                found += [(lo + int(doc), block.items[q], block.totals[q], block.numbers[q], score, got, told) for (doc, q), (got, told, score) in top.items()]
            if found:
                row = [x[0] for x in found]
                ids, keys = (b.column(b.schema.get_field_index(c)).take(pa.array(row)) for c in ("doc_id", "text_hash"))
                yield pa.RecordBatch.from_arrays([ids, keys, *[pa.array([x[k] for x in found], _HIT.field(k + 1).type) for k in range(1, 7)]], schema=_HIT)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.4, common: float = 0.6, answer: float = 0.5, rank: int = RANK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, verbatim or rephrased.

    Returns doc_id, text_hash (of the text, to tell rows of one id apart), item_id, cosine (of the
    best passage), common (share of the item's words in longest common subsequences) and answer
    (that share of its last sentence), one row per document row's id, text and item.

    Items without words or id match nothing; equal items match alike; items of any length are found, those of
    more than SECTION words section by section.  Items that share an id count as one if they are equal, and are
    told apart by their number of words if not.  Null text is empty.  A document with null id is reported with it.
    Repeated rows are reported once.  Empty tables give an empty table; other columns are ignored, whatever
    their names.
    """
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.lower(text).alias("text"))
    out = docs.sparkSession.createDataFrame([], HITS)
    for block in item_blocks(benchmark, item_col, item_text_col):
        size = len(block.vocabulary)
        numbered = staged(rows.mapInArrow(_number(block.vocabulary), "doc_id bigint, text_hash bigint, n int, seq binary"), "leak-sequences")
        counts = _summed(numbered.select("n", "seq").mapInArrow(_frequencies(size), "k int, v binary"), np.int64)
        counts = counts if counts is not None else np.zeros(size + 1, np.int64)
        rare, every = weights(counts[:size], counts[size])
        # LEAST_TERMS weighted words to a passage, so that some of its passages stand out when words are replaced
        rich = [(rare[w.astype(np.int64)] > 0).sum() >= LEAST_TERMS * max(1, len(w) / (2 * SEGMENT)) for w in block.words]
        for weight, which, terms in ((rare, [k for k, r in enumerate(rich) if r], LEAST_TERMS), (every, [k for k, r in enumerate(rich) if not r], 1)):
            if which:
                space = latent_space(numbered, weight, rank)
                out = out.unionAll(staged(numbered.mapInArrow(_search(block.part(which), weight, space, terms, cosine, common), HITS), "leaks"))
    # a section's best passage; then the item's sections together
    best = F.max(F.struct("common", "answer", "cosine")).alias("b")
    found = out.groupBy("doc_id", "text_hash", "item_id", "total", "section").agg(best)
    whole = found.groupBy("doc_id", "text_hash", "item_id", "total").agg(F.max("b.cosine").alias("cosine"), (F.sum("b.common") / F.col("total")).alias("common"), F.max("b.answer").alias("answer"))
    kept = whole.where((F.col("common") >= common) & (F.col("answer") >= answer))
    same = F.max(F.struct("common", "answer", "cosine")).alias("b")
    return kept.groupBy("doc_id", "text_hash", "item_id").agg(same).select("doc_id", "text_hash", "item_id", "b.cosine", "b.common", "b.answer")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of docs that hold no benchmark item, unchanged, with the columns of docs whatever their names.

    Null text holds nothing and stays; repeated rows stay or go together; a row with a null id is judged by its
    text; an empty table gives an empty table."""
    # staged, so that its size is known and Spark broadcasts it only below its own bound
    bad = staged(find_leaks(docs, benchmark, **settings).select("doc_id", "text_hash").distinct(), "leaked")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    keyed = docs.select(docs["doc_id"].cast("bigint").alias("k_id"), F.xxhash64(text_of(docs)).alias("k_hash"), row)
    return keyed.join(bad, keyed.k_id.eqNullSafe(bad.doc_id) & (keyed.k_hash == bad.text_hash), "left_anti").select("row.*")
