"""Sketches keep unlike sets out of the candidate groups of the Jaccard join and lose no link."""

import random

import numpy as np
import pyarrow as pa
from cuemill.llm import jaccard

U = np.uint64


def family(r, n, share, sets):
    """Sets of n elements or so, each with a few others in place of some; share: of the elements at most."""
    base = r.integers(0, 1 << 63, n, dtype=U)
    for _ in range(sets):
        k = int(r.integers(0, int(n * share) + 1))
        yield np.unique(np.concatenate([base[r.permutation(n)[k:]], r.integers(0, 1 << 63, k, dtype=U)]))


def bounded(sets):
    return np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))


def test_chance_fragments_tie_no_unlike_sets(spark, monkeypatch):
    """Unlike documents with common lines formed groups that grew with the corpus, each checked pair by pair."""
    kept = {}
    monkeypatch.setattr(jaccard, "staged", lambda df, name, f=jaccard.staged: kept.setdefault(name, f(df, name)))
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    lines = [" ".join(word() for _ in range(12)) for _ in range(6)]
    rows = [(k, " ".join([word() for _ in range(100)] + r.sample(lines, 3))) for k in range(300)]
    rows += [(1000 + k, rows[k][1] + " " + word()) for k in range(5)]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert {x.doc_id: x.component_id for x in got} == {k: k - 1000 if k >= 1000 else k for k, _ in rows}
    assert {x.doc_id for x in got if x.n_links} == {*range(5), *range(1000, 1005)}
    assert len({frozenset((x.u, x.v)) for x in kept["jaccard-ties"].collect()}) == 5


def test_sketches_differ_by_no_more_than_the_sets():
    r = np.random.Generator(np.random.PCG64(5))
    for percent in (60, 80, 90):
        levels = jaccard.Levels(percent)
        for n in (4, 9, 40, 200, 900, 5000):
            sets = [*family(r, n, 0.4, 8)]
            words, at = jaccard.sketches(*bounded(sets), levels)
            size = max(1, int(np.diff(at)[np.diff(at) > 0].min(initial=64)))
            rows = jaccard._folded(words, at, size)
            for i in range(8):
                for j in range(8):
                    if at[i] < at[i + 1] and at[j] < at[j + 1]:
                        assert np.bitwise_count(rows[i] ^ rows[j]).sum() <= len(np.setxor1d(sets[i], sets[j]))


def test_every_link_is_tied_by_any_way(monkeypatch):
    """Pairs, groups, groups too large for sketches and buckets beyond the buffer, against all links."""
    r = np.random.Generator(np.random.PCG64(6))
    percent = 80
    levels = jaccard.Levels(percent)
    sets = [s for n in (5, 12, 60, 150, 151, 700) for s in family(r, n, 0.2, 40)]
    h, bounds = bounded(sets)
    n = np.diff(bounds)
    c, _ = jaccard._digests(h, bounds)
    place = {k: i for i, k in enumerate(c.tolist())}
    one_each = sorted(place.values())
    links = {(i, j) for i in one_each for j in one_each if i > j and 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
    assert len(links) > 200
    owner, sig, level = jaccard._signatures(h, bounds, levels)
    words, at = jaccard.sketches(h, bounds, levels)
    blob = [words[at[i] : at[i + 1]].tobytes() for i in range(len(sets))]
    for paired, most, buffer, cache in ((64, 1 << 16, 1 << 22, 1 << 24), (2, 1 << 16, 1 << 22, 2000), (2, 10, 1 << 22, 1 << 24), (4, 1 << 16, 50, 1 << 24)):
        monkeypatch.setattr(jaccard, "PAIRED", (paired, paired))
        monkeypatch.setattr(jaccard, "GROUP_SETS", most)
        monkeypatch.setattr(jaccard, "BUFFER", buffer)
        monkeypatch.setattr(jaccard, "SKETCH_BYTES", cache)
        rows = []
        for one in np.unique(level).tolist():
            pair = np.stack([sig[level == one], c[owner[level == one]].view(U)], 1)
            rows += [(int(one), pair[k : k + 100].tobytes()) for k in range(0, len(pair), 100)]
        batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "pairs"])
        met = [x for b in jaccard._tie_all(percent)([batch]) for x in b.to_pylist()]
        drawn = sorted({(x["level"], x["g"], x["u"]) for x in met if x["v"] is None})
        cols = [*zip(*[(one, g, k, int(n[place[k]]), blob[place[k]]) for one, g, k in drawn], strict=True)] or [()] * 5
        table = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["level", "g", "c", "n", "sketch"])
        pieces = [table.slice(k, 37) for k in range(0, table.num_rows, 37)]
        ties = [(x["level"], place[x["u"]], place[x["v"]]) for x in met if x["v"] is not None]
        ties += [(x["level"], place[x["u"]], place[x["v"]]) for b in jaccard._refine(percent)(pieces) for x in b.to_pylist()]
        group = {}
        for one, i, j in ties:
            a, b = group.get((one, i), {i}), group.get((one, j), {j})
            for k in a | b:
                group[one, k] = a | b
        for i, j in links:
            one = int(levels.of(min(n[i], n[j])))
            assert j in group[one, i]
