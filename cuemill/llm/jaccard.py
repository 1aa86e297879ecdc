"""N-gram Jaccard join by vertical partitioning.

The global order of shingles is the order of their 64-bit hashes.  Two sets with Jaccard similarity
of at least t differ in at most d elements, so when the order is cut into d + 1 fragments at least
one fragment of theirs is equal; equal fragments yield the candidates.  d depends on the set size,
hence sets are put into size levels (a set also joins the level below when a partner may be there).
An empty fragment says nothing, so there are some fragments more, for as many empty ones; a set with
still more empty ones is cut again by other orders, and in the end by a prefix filter, so no link is
lost.  Sets that have an equal fragment are tied only if their sketches allow a link: a sketch holds the parity of
the number of elements at each of its bits, so two sketches differ in at most as many bits as the sets differ in
elements.  Else chance fragments of one shingle would join unlike sets into groups that outgrow the corpus.

Groups of candidates are kept apart by level, so their sets are of
about one size.  A group is cut into blocks of up to ``BLOCK_SETS`` sets; each pair of blocks is a task's work, in which
the overlaps are counted fragment by fragment and summed per pair.  Only the number of links and a spanning
forest leave the task, never the pairs.  Counting links takes all pairs of a group, so a group of g
different sets costs g / BLOCK_SETS copies of each set in the shuffle.

Rows with equal sets are one class from the start, so that copies cost nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import LOWER, join_split, mix, staged, sums_by_row, text_of, word_blocks
from ._graph import components

U = np.uint64
GROWTH = 1.25
LAYOUTS = 4
LAYOUT_KEYS = mix(np.arange(1, LAYOUTS + 1, dtype=U))
BLOCK_SETS = 4096
BLOCK_SHINGLES = 2_000_000
LEVEL_BITS = 128
BUFFER = 4_000_000
FRAGMENT_TOKENS = 1024
FEW_SETS = 32
#: Signatures of up to this many classes, by level from the first to the second number, are taken pair by pair.
PAIRED = (4, 64)
#: Signatures of more classes are tied without a look at sketches.
GROUP_SETS = 1 << 16
SKETCH_BYTES = 1 << 24


def shingle_sets(column: pa.Array, width: int):
    """(first row, end row, hashes, bounds) by block: row i has the sorted distinct hashes bounds[i]:bounds[i+1]."""
    factors = mix(np.arange(1, width + 1, dtype=U)) | U(1)
    for lo, hi, words in word_blocks(column):
        h = words.hashes(LOWER)
        n_rows, count = hi - lo, words.count
        made = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
        at = np.concatenate(([0], np.cumsum(made)))
        first = np.repeat(words.rows[:-1] - at[:-1], made) + np.arange(at[-1])
        row = np.repeat(np.arange(n_rows), made)
        size = np.minimum(count, width)[row]
        total = size.astype(U) * U(0xD6E8FEB86659FD93)
        for k in range(width):
            ok = size > k
            total[ok] += h[first[ok] + k] * factors[k]
        sh = mix(total)
        for i in np.flatnonzero(made > 1):
            sh[at[i] : at[i + 1]].sort()
        fresh = np.ones(len(sh), bool)
        if len(sh):
            fresh[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
        yield lo, hi, sh[fresh], np.concatenate(([0], np.cumsum(np.bincount(row[fresh], minlength=n_rows))))


class Levels:
    """Size levels for a similarity of at least percent/100, and the number of fragments of each."""

    def __init__(self, percent: int, largest: int = 1 << 31):
        self.percent = percent
        self.least = -(-percent // (100 - percent))  # smaller sets link with equal sets only
        starts = [self.least]
        while starts[-1] < largest:
            starts.append(max(starts[-1] + 1, int(starts[-1] * max(GROWTH, 100 / percent + 0.05))))
        self.starts = np.array(starts)
        # sets a <= b with 100 i >= percent * u differ in at most (100 - percent) / percent * a elements
        differ = (self.starts[1:] - 1) * (100 - percent) // percent
        spare = np.zeros(len(differ), np.int64)
        for _ in range(20):  # spare fragments: about the empty ones that a set of the least size has, and some
            m = differ + 1 + spare
            empty = m * np.exp(-self.starts[:-1] / m)
            spare = np.ceil(empty + 2 * np.sqrt(empty)).astype(np.int64)
        self.spare, self.fragments = spare, differ + 1 + spare
        # words of a sketch: unlike sets differ in about half of its bits, which is to be more than differ
        self.words = 1 << np.ceil(np.log2(np.maximum(1, (2.25 * differ + 48) / 64))).astype(np.int64)
        self.paired = np.clip(self.fragments // 8, *PAIRED)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, n, "right") - 1

    def partner(self, n: np.ndarray) -> np.ndarray:
        return self.of(np.maximum(-(-n * self.percent // 100), self.least))


def _cut(h, row, wanted, level, fragments, spare, layout):
    """Signatures (row, hash) of the non-empty fragments of rows in wanted, and the rows with too many empty ones."""
    keep = wanted[row]
    h, row = h[keep], row[keep]
    if layout:
        h = mix(h + LAYOUT_KEYS[layout])
        by = np.lexsort((h, row))
        h, row = h[by], row[by]
    if not len(h):
        return row, h, np.zeros(len(wanted), bool)
    part = ((h >> U(32)) * fragments[row].astype(U)) >> U(32)
    start = np.ones(len(h), bool)
    start[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
    at = np.flatnonzero(start)
    inside = np.add.reduceat(mix(h ^ U(0xE7037ED1A0B428DB)), at)
    owner = row[at]
    sig = mix(inside + part[at] * U(0x8EBC6AF09C88C6E3) + level[owner].astype(U) * U(0x589965CC75374CC3) + LAYOUT_KEYS[layout])
    return owner, sig, wanted & (np.bincount(owner, minlength=len(wanted)) < fragments - spare)


def _signatures(h, bounds, levels: Levels):
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    owners, sigs, at_level = [], [], []
    own, low = levels.of(n), levels.partner(n)
    for level, wanted in ((own, n >= levels.least), (low, (n >= levels.least) & (low != own))):
        at = np.clip(level, 0, len(levels.fragments) - 1)
        fragments, spare = levels.fragments[at], levels.spare[at]
        for layout in range(LAYOUTS):
            if wanted.any():
                owner, sig, wanted = _cut(h, row, wanted, level, fragments, spare, layout)
                owners.append(owner)
                sigs.append(sig)
                at_level.append(level[owner])
        if wanted.any():  # the prefix filter: similar sets share one of their first elements
            prefix = n - -(-n * levels.percent // 100) + 1
            rank = np.arange(len(h)) - bounds[row]
            keep = wanted[row] & (rank < prefix[row])
            owners.append(row[keep])
            sigs.append(mix(h[keep] + U(0x2545F4914F6CDD1D)))
            at_level.append(level[row[keep]])
    owner, sig, level = (np.concatenate(x) if x else np.zeros(0, U) for x in (owners, sigs, at_level))
    return owner.astype(np.int64), sig, level.astype(np.int64)


def _digests(h, bounds):
    """Two 64-bit digests of each set."""
    n = np.diff(bounds).astype(U)
    one, two = (sums_by_row(mix(h ^ U(k)), bounds) for k in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F))
    return mix(one + n).view(np.int64), two.view(np.int64)


def sketches(h, bounds, levels: Levels):
    """(words, bounds): the sketch of set i, of as many words as its own level has, is words[bounds[i]:bounds[i+1]].

    A bit is set if an odd number of elements falls on it."""
    n = np.diff(bounds)
    size = np.where(n < levels.least, 0, levels.words[np.clip(levels.of(n), 0, len(levels.words) - 1)])
    at = np.concatenate(([0], np.cumsum(size)))
    bits = np.repeat(size * 64, n)
    has = bits > 0
    spot = mix(h[has] ^ U(0x94D049BB133111EB)) & (bits[has] - 1).astype(U)
    odd = np.bincount(spot.astype(np.int64) + np.repeat(at[:-1] * 64, n)[has], minlength=at[-1] * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U), at


def _folded(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sketches as rows of size words; longer ones are folded, which keeps the parities."""
    out, n = np.zeros((len(at) - 1, size), U), np.diff(at)
    for k in np.unique(n).tolist():
        rows = np.flatnonzero(n == k)
        out[rows] = np.bitwise_xor.reduce(words[at[rows][:, None] + np.arange(k)].reshape(len(rows), k // size, size), axis=1)
    return out


def _scan(width: int, percent: int):
    def run(batches):
        levels = Levels(percent)
        for b in batches:
            for lo, hi, h, bounds in shingle_sets(b.column(2), width):
                one, two = _digests(h, bounds)
                words, at = sketches(h, bounds, levels)
                sketch = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(words)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(bounds), pa.int64()), pa.array(one), pa.array(two), sketch], ["doc_id", "text_hash", "n", "c", "c2", "sketch"])

    return run


def _fragments(width: int, percent: int, buckets: int):
    """Batches to (bucket, pairs): pairs is a binary array of (fragment signature, class), each class once a batch.

    A bucket is of one size level, which its number modulo LEVEL_BITS tells."""

    def run(batches):
        levels = Levels(percent)
        for b in batches:
            seen: set[int] = set()
            pairs, at_level = [], []
            for _, _, h, bounds in shingle_sets(b.column(0), width):
                c, _ = _digests(h, bounds)
                owner, sig, level = _signatures(h, bounds, levels)
                new = np.zeros(len(c), bool)
                for i, k in enumerate(c.tolist()):
                    if k not in seen:
                        seen.add(k)
                        new[i] = True
                keep = new[owner]
                pairs.append(np.stack([sig[keep], c[owner[keep]].view(U)], 1))
                at_level.append(level[keep])
            if not pairs:
                continue
            pair = np.concatenate(pairs)
            bucket = ((pair[:, 0] >> U(32)) * U(buckets) >> U(32)).astype(np.int64) * LEVEL_BITS + np.concatenate(at_level)
            pair = pair[np.argsort(bucket, kind="stable")]
            bounds = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets * LEVEL_BITS))))
            used = np.flatnonzero(np.diff(bounds))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([pair[bounds[k] : bounds[k + 1]].tobytes() for k in used], pa.binary())], ["bucket", "pairs"])

    return run


def _ties(pair: np.ndarray):
    """Each signature once, with its smallest class; and the edges from that class to the signature's others."""
    sig, c = pair[:, 0], pair[:, 1].view(np.int64)
    by = np.lexsort((c, sig))
    sig, c = sig[by], c[by]
    start = np.ones(len(sig), bool)
    start[1:] = sig[1:] != sig[:-1]
    low = c[np.maximum.accumulate(np.where(start, np.arange(len(sig)), 0))]
    tied = c != low
    edges = np.unique(np.stack([c[tied], low[tied]], 1), axis=0) if tied.any() else np.zeros((0, 2), np.int64)
    return np.stack([sig[start], c[start].view(U)], 1), edges


def _members(pair: np.ndarray, paired: int):
    """(group, class) of the signatures of several classes, by pairs where there are up to paired, each group once;
    and edges from the smallest class to the others for signatures of more than GROUP_SETS."""
    pair = np.unique(np.ascontiguousarray(pair).view("u8,u8").ravel())
    sig, c = pair["f0"], pair["f1"].view(np.int64)
    at = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    size = np.diff(np.append(at, len(sig)))
    by_pair = np.repeat((size > 1) & (size <= paired), size)
    few_sig, few = sig[by_pair], c[by_pair]
    ends = []
    for step in range(1, paired):
        same = np.flatnonzero(few_sig[step:] == few_sig[:-step])
        if not len(same):
            break
        ends.append(np.sort(np.stack([few[same], few[same + step]], 1), axis=1))
    ends = np.unique(np.concatenate(ends), axis=0) if ends else np.zeros((0, 2), np.int64)
    of_pair = mix(mix(ends[:, 0].view(U) if len(ends) else np.zeros(0, U)) + U(3) * mix(np.ascontiguousarray(ends[:, 1]).view(U)))
    inside = np.add.reduceat(mix(c.view(U)), at)
    many = np.flatnonzero((size > paired) & (size <= GROUP_SETS))
    many = many[np.unique(inside[many], return_index=True)[1]]
    rows = np.repeat(at[many] - np.concatenate(([0], np.cumsum(size[many])[:-1])), size[many]) + np.arange(size[many].sum())
    group = np.concatenate([np.repeat(of_pair, 2), np.repeat(mix(inside[many]), size[many])]).view(np.int64)
    huge = np.repeat(size > GROUP_SETS, size)
    return group, np.concatenate([ends.ravel(), c[rows]]), _ties(np.stack([sig[huge], c[huge].view(U)], 1))[1]


def _tie_all(percent: int):
    """Rows sorted by bucket to members (v null) and edges; of a bucket beyond the buffer, one pair a signature is kept, and edges."""

    def batch(now, group, u, v):
        level = np.full(len(u), now % LEVEL_BITS, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(group, pa.int64()) if group is not None else pa.nulls(len(u), pa.int64()), pa.array(level), pa.array(np.ascontiguousarray(u)), pa.array(np.ascontiguousarray(v)) if v is not None else pa.nulls(len(u), pa.int64())], ["g", "level", "u", "v"])

    def run(batches):
        levels = Levels(percent)
        now, held, size, over = None, [], 0, False

        def end():
            if over:
                edges = _ties(np.concatenate(held))[1]
            else:
                group, member, edges = _members(np.concatenate(held), int(levels.paired[min(now % LEVEL_BITS, len(levels.paired) - 1)]))
                yield batch(now, group, member, None)
            yield batch(now, None, edges[:, 0], edges[:, 1])

        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if held and bucket != now:
                    yield from end()
                    held, size, over = [], 0, False
                elif held and size > BUFFER:
                    pair, edges = _ties(np.concatenate(held))
                    yield batch(now, None, edges[:, 0], edges[:, 1])
                    held, size, over = [pair], 0, True
                now = bucket
                held.append(np.frombuffer(blob.as_buffer(), U).reshape(-1, 2))
                size += len(held[-1])
        if held:
            yield from end()

    return run


def _alike(level: int, levels: Levels, n: np.ndarray, sketch: np.ndarray):
    """Test of rows i and j: whether, by sketches and sizes, they may link at the level."""
    own = levels.of(n) == level  # a pair counts at the level of its smaller set

    def test(i, j):
        differ = np.maximum(np.bitwise_count(sketch[i] ^ sketch[j]).sum(-1, dtype=np.int64), np.abs(n[i] - n[j]))
        return (own[i] | own[j]) & (differ * (100 + levels.percent) <= (n[i] + n[j]) * (100 - levels.percent))

    return test


def _closest(test, rows: np.ndarray):
    """Edges from rows to the first row of what they reach by pairs that pass the test."""
    rest, u, v = rows, [], []
    while len(rest):
        root, front, rest = rest[0], [rest[0]], rest[1:]
        while len(front) and len(rest):
            met = []
            for i in front:
                hit = test(i, rest)
                if hit.any():
                    met.extend(rest[hit].tolist())
                    rest = rest[~hit]
            u.extend(met)
            v.extend([root] * len(met))
            front = met
    return np.array(u, np.int64), np.array(v, np.int64)


def _refine(percent: int):
    """Rows (level, g, c, n, sketch) sorted by level and g to edges between classes that may link and share a group."""

    def settle(levels, level, g, c, n, words, at):
        size = np.diff(at)
        for one in np.unique(level).tolist():
            rows = np.flatnonzero(level == one)
            first = np.concatenate(([True], (g[rows][1:] != g[rows][:-1]) | (c[rows][1:] != c[rows][:-1])))
            rows = rows[first]
            k = int(levels.words[min(one, len(levels.words) - 1)])
            to = np.concatenate(([0], np.cumsum(size[rows])))
            taken = words[np.repeat(at[rows] - to[:-1], size[rows]) + np.arange(to[-1])]
            test = _alike(one, levels, n[rows], _folded(taken, to, k))
            group, cls = g[rows], c[rows]
            start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            many = np.diff(np.append(start, len(group)))
            pairs = start[many == 2]
            pairs = pairs[test(pairs, pairs + 1)]
            u, v = [pairs], [pairs + 1]
            for i in np.flatnonzero(many > 2).tolist():
                x, y = _closest(test, np.arange(start[i], start[i] + many[i]))
                u.append(x)
                v.append(y)
            edges = np.unique(np.stack([cls[np.concatenate(u)], cls[np.concatenate(v)]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[:, 0])), pa.array(np.ascontiguousarray(edges[:, 1])), pa.array(np.full(len(edges), one, np.int32))], ["u", "v", "level"])

    def run(batches):
        levels, held, size = Levels(percent), [], 0

        def parts(last):
            nonlocal held, size
            table = pa.Table.from_batches(held).combine_chunks()
            level, g, c, n = (table.column(k).to_numpy() for k in range(4))
            whole = len(g) if last else int(np.flatnonzero((level != level[-1]) | (g != g[-1]))[-1:].sum() + 1) * bool((level != level[-1]).any() or (g != g[-1]).any())
            held, size = ([] if last else table.slice(whole).to_batches()), 0
            if whole:
                blob = table.column(4).slice(0, whole).combine_chunks()
                blob = blob.chunk(0) if isinstance(blob, pa.ChunkedArray) else blob
                offsets = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + whole + 1].astype(np.int64)
                words = np.frombuffer(blob.buffers()[2], U, count=(offsets[-1]) // 8) if offsets[-1] else np.zeros(0, U)
                yield from settle(levels, level[:whole], g[:whole], c[:whole], n[:whole], words, offsets // 8)

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size > SKETCH_BYTES:
                yield from parts(False)
        if held:
            yield from parts(True)

    return run


def _sets(width: int):
    def run(batches):
        for b in batches:
            for lo, hi, h, bounds in shingle_sets(b.column(b.schema.get_field_index("text")), width):
                cols = [b.column(b.schema.get_field_index(x)).slice(lo, hi - lo) for x in ("c", "w", "comp", "level", "nb")]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))], ["c", "w", "comp", "level", "nb", "s"])

    return run


def overlaps(sets: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """Matrix of intersection sizes: partial counts in each fragment of the order, summed per pair.

    Its rows are the sets of side 0 and 1, its columns those of side 0 and 2: all pairs of one block, or
    those between two blocks."""
    token = np.concatenate(sets)
    by = np.argsort(token, kind="stable")
    token = token[by]
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[by]
    shared = ~first
    shared[:-1] |= ~first[1:]  # a token of one set alone is in no intersection
    column = (np.cumsum(first[shared]) - 1).astype(np.int32)
    row = row[shared]
    down, across = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
    total = np.zeros((len(down), len(across)), np.float32)
    # tokens of few sets are counted pair by pair, the others by products of fragments
    often = np.bincount(column)[column] > FEW_SETS if len(column) else np.zeros(0, bool)
    at_down, at_across = np.full(len(sets), -1), np.full(len(sets), -1)
    at_down[down], at_across[across] = np.arange(len(down)), np.arange(len(across))
    few_row, few_column = row[~often], column[~often]
    for step in range(1, FEW_SETS):
        same = np.flatnonzero(few_column[step:] == few_column[:-step])
        if not len(same):
            break
        for x, y in ((few_row[same], few_row[same + step]), (few_row[same + step], few_row[same])):
            ok = (at_down[x] >= 0) & (at_across[y] >= 0)
            np.add.at(total, (at_down[x[ok]], at_across[y[ok]]), 1)
    row, column = row[often], column[often]
    if len(column):
        column = np.cumsum(np.diff(column, prepend=column[0]) > 0)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, FRAGMENT_TOKENS):
        a, b = np.searchsorted(column, (start, start + FRAGMENT_TOKENS))
        part = np.zeros((len(sets), FRAGMENT_TOKENS), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        total += part[down] @ part[across].T
    return total


def _reached(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Component numbers of the rows and the columns of a matrix of links; same if both are the same sets."""
    rows, columns = np.full(linked.shape[0], -1), np.full(linked.shape[1], -1)
    for k in range(len(rows)):
        if rows[k] >= 0:
            continue
        front = np.array([k])
        rows[k] = k
        while len(front):
            met = np.flatnonzero(linked[front].any(0) & (columns < 0))
            columns[met] = k
            front = met if same else np.flatnonzero(linked[:, met].any(1) & (rows < 0))
            front = front[rows[front] < 0]
            rows[front] = k
    return rows, columns


def _verify(percent: int):
    levels = Levels(percent)

    def group(rows, level):
        """One pair of blocks of one candidate group: links of each class, and a spanning forest."""
        c = np.array([r[0] for r in rows], np.int64)
        w = np.array([r[1] for r in rows], np.int64)
        side = np.array([r[2] for r in rows])
        n = np.array([len(r[3]) for r in rows], np.int64)
        same = not side.any()
        down, across = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
        got = overlaps([r[3] for r in rows], side)
        linked = np.zeros(got.shape, bool)
        for k, i in enumerate(down):
            # a pair counts at the level of its smaller set, though both may meet at the level below too
            at_level = levels.of(np.minimum(n[i], n[across])) == level
            linked[k] = (100 * got[k] >= percent * (n[i] + n[across] - got[k])) & at_level
        if same:
            np.fill_diagonal(linked, False)
        of_rows, of_columns = _reached(linked, same)
        met = of_columns >= 0
        if same:
            return c, c[of_rows], linked @ w
        u = np.concatenate((c[down], c[across][met]))
        v = np.concatenate((c[down][of_rows], c[down][of_columns[met]]))
        return u, v, np.concatenate((linked @ w[across], (linked.T @ w[down])[met]))

    def run(batches):
        key, rows, out = None, [], []

        def flush():
            if len(rows) > 1:
                out.append(group(rows, key[1]))

        def pack():
            got = [np.concatenate(x) for x in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["u", "v", "links"])

        for b in batches:
            comp, level, i, j, c, w, side = (b.column(k).to_pylist() for k in range(7))
            values, at = b.column(7).values.to_numpy(), b.column(7).offsets.to_numpy()
            for k in range(b.num_rows):
                now = (comp[k], level[k], i[k], j[k])
                if now != key:
                    flush()
                    key, rows = now, []
                if rows and rows[-1][0] == c[k]:  # a representative that the table has more than once
                    continue
                rows.append((c[k], w[k], side[k], values[at[k] : at[k + 1]].copy()))
            if len(out) > 2000:
                yield pack()
        flush()
        if out:
            yield pack()

    return run


def _classes(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The rows of jaccard_classes with text_hash and root, which numbers the groups (null: no words)."""
    if not 50 <= percent < 100:
        raise ValueError("percent must be from 50 to 99")
    text = text_of(docs, text_col)
    base = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    scanned = staged(base.mapInArrow(_scan(width, percent), "doc_id bigint, text_hash bigint, n bigint, c bigint, c2 bigint, sketch binary"), "jaccard-scan")
    least = Levels(percent).least
    found = scanned.where(F.col("n") >= least).groupBy("c", "c2").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("rep"), F.count("*").alias("w"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = staged(found, "jaccard-classes")
    # candidates: classes with an equal fragment, at one size level, whose sketches allow a link
    shingles = scanned.agg(F.sum("n")).first()[0] or 0
    buckets = max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4, shingles // (2 * BUFFER))
    blobs = base.select("text").mapInArrow(_fragments(width, percent, buckets), "bucket int, pairs binary")
    met = staged(blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_tie_all(percent), "g bigint, level int, u bigint, v bigint").distinct(), "jaccard-members")
    drawn = met.where("v is null").select("level", "g", F.col("u").alias("c")).join(classes.select("c", "n", "sketch"), "c").select("level", "g", "c", "n", "sketch")
    near = drawn.repartition("level", "g").sortWithinPartitions("level", "g", "c").mapInArrow(_refine(percent), "u bigint, v bigint, level int")
    tied = staged(near.unionAll(met.where("v is not null").select("u", "v", "level")).distinct(), "jaccard-ties")
    node = lambda c: F.xxhash64(c, "level")
    ends = tied.select(F.col("u").alias("c"), "level").unionAll(tied.select(F.col("v").alias("c"), "level")).distinct().withColumn("id", node("c"))
    found = components(tied.select(node("u").alias("u"), node("v").alias("v")), "jaccard-candidates").withColumnRenamed("root", "comp")
    groups = ends.join(found, F.col("id") == F.col("node")).select("c", "level", "comp").join(classes, "c")
    groups = staged(groups.select("c", "level", "comp", "w", "n", F.col("rep.doc_id").alias("r_id"), F.col("rep.text_hash").alias("r_hash")), "jaccard-groups")
    sized = groups.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    wanted = join_split(groups, sized, "comp").select("c", "w", "comp", "level", "nb", "r_id", "r_hash")
    # by a merge at any size: whether wanted is small enough for a broadcast hangs on how much of the corpus is alike
    texts = base.join(wanted.hint("merge"), base.doc_id.eqNullSafe(wanted.r_id) & (base.text_hash == wanted.r_hash)).select("c", "w", "comp", "level", "nb", "text")
    one = texts.mapInArrow(_sets(width), "c bigint, w bigint, comp bigint, level int, nb int, s array<bigint>")
    # side: 0 in a block paired with itself, else 1 or 2 by which of the two blocks holds the row
    block = F.pmod(F.xxhash64("c"), F.col("nb")).cast("int")
    placed = one.withColumn("b", block).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    pairs = placed.select("comp", "level", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "c", "w", F.when(F.col("b") == F.col("o"), 0).when(F.col("b") < F.col("o"), 1).otherwise(2).alias("side"), "s")
    keys = ["comp", "level", "i", "j"]
    checked = staged(pairs.repartition(*keys).sortWithinPartitions(*keys, "c").mapInArrow(_verify(percent), "u bigint, v bigint, links bigint"), "jaccard-links")
    roots = components(checked.select("u", "v"), "jaccard-components")
    links = checked.groupBy("u").agg(F.sum("links").alias("more"))
    own = scanned.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("low"), F.count("*").alias("w"))
    near = own.join(roots, own.c == roots.node, "left").join(links, own.c == links.u, "left").select("c", "low", "w", F.coalesce("root", "c").alias("root"), F.coalesce("more", F.lit(0)).alias("more"))
    least_id = near.groupBy("root").agg(F.min("low").alias("component"))
    by_class = near.join(least_id, "root").select(F.col("c").alias("k"), "root", "component", (F.col("w") - 1 + F.col("more")).alias("links"))
    out = scanned.select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.col("c")).alias("c")).join(by_class, F.col("c") == F.col("k"), "left")
    return out.select("doc_id", "text_hash", "root", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"))


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate classes of whole texts by word shingles.

    Words are lower-cased (A-Z) runs outside white space.  A document's set holds its distinct
    ``width``-word shingles; with fewer words, the whole sequence; without words (or with null text)
    it is empty and links with nothing.  Two documents link when
    ``100 * |A and B| >= percent * |A or B|``.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest id reachable by links,
    itself included) and n_links (number of other rows it links with).  Repeated rows are linked
    copies.  A row with null id keeps its place; ids that are null never become component_id unless
    the component has no other.  Other columns of docs are ignored, whatever their names.  An empty
    table gives an empty table.  Shingles and sets are told apart by 64-bit hashes.
    """
    return _classes(docs, width, percent, id_col, text_col).drop("text_hash", "root")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates: of each group the row with the smallest doc_id stays (ties: smallest text hash).

    Rows without words stay, null texts among them.  Repeated rows of one id and text count as one, and the first of
    them that a task meets stays; a null id comes last.  Columns stay as they are, whatever their names; an empty
    table stays empty."""
    found = _classes(docs, width, percent, "doc_id", "text")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("best")
    kept = found.where("root is not null").groupBy("root").agg(best).select("best.doc_id", "best.text_hash")
    kept = kept.unionAll(found.where("root is null").select("doc_id", "text_hash")).distinct()
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    keyed = docs.select(docs["doc_id"].cast("bigint").alias("k_id"), F.xxhash64(text_of(docs)).alias("k_hash"), row)
    met = keyed.join(kept, keyed.k_id.eqNullSafe(kept.doc_id) & (keyed.k_hash == kept.text_hash), "left_semi")
    return met.dropDuplicates(["k_id", "k_hash"]).select("row.*")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 90 * (a.n + b.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
k AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM d JOIN m ON m.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.x = d.doc_id
"""
