"""Catalogued queries over whole rows and texts, against plain models on small tables."""

import datetime
import random

from pyspark.sql import functions as F

from cuemill.functions import distance
from cuemill.operators import segment
from cuemill.plans import catalog
from test_functions import brute_tracks


def save(spark, tmp_path, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    return str(tmp_path)


def test_track_objects_takes_every_item_of_a_frame(spark, tmp_path):
    rng = random.Random(7)
    parts = ["1234567", "1234568", "1299999", "1"]
    rows = [(m, f, int(rng.choice(parts)), k, float(5 * rng.randint(1, 10)), rng.randint(0, 10) / 100, 0.0) for m in (1, 2) for f in (1, 2, 3, 5, 6, 7, 8) for k in range(rng.randint(1, 4))]
    sf = save(spark, tmp_path, "lineitem", rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_discount double, l_tax double")
    got = catalog.track_objects(spark, sf).collect()
    for m in (1, 2):
        items = [(f, str(p), round(q / 50 / 10, 2), round(d * 10 / 10, 2)) for media, f, p, _, q, d, _ in rows if media == m]
        want = brute_tracks(sorted(items, key=lambda r: (r[0], r[1])))
        assert sorted((r.first_frame, r.end_frame, r.text, r.x, r.y) for r in got if r.media_id == m) == want
        assert any(b - a > 1 for a, b, *_ in want) and sum(b - a for a, b, *_ in want) == len(items)


def ratio(a, b):
    return distance.ratio(a, b)


def collapsed(texts):
    """(position, anchor position, anchor) of texts in order."""
    out, anchor = [], None
    for k, t in enumerate(texts):
        if anchor is None or not ratio(anchor[1], t) < 0.2:
            anchor = (k, t)
        out.append((k, *anchor))
    return out


def test_near_dup_collapse(spark, tmp_path):
    rng = random.Random(3)
    head = "".join(rng.choices("abcdeé ", k=150))
    tails = ["".join(rng.choices("abcdeéß\n", k=n)) for n in (150, 150, 400, 0)]
    texts = [head + t for t in tails] + [head + tails[0][:-5] + "xyzzy", head + tails[2][:-40], "", "", "ééééé", "éééßé", "ßßßßß", head[:100]]
    rows = [(k, t, "ab"[k % 2]) for k, t in enumerate(texts * 2)]
    want = set()
    ordered = {}
    for lang in "ab":
        ordered[lang] = sorted(((t, k) for k, t, x in rows if x == lang), key=lambda r: (r[0].encode(), r[1]))
        want |= {(lang, k, a, t) for k, a, t in collapsed([t for t, _ in ordered[lang]])}
    df = spark.createDataFrame([(lang, k, t) for lang in "ab" for k, (t, _) in enumerate(ordered[lang])], "lang string, seq bigint, text string")
    got = segment.collapse_similar(df, key="lang").select("lang", "seq", "anchor_seq", "anchor_text")
    assert {tuple(r) for r in got.collect()} == want
    assert any(len(w[3]) > 300 and w[1] != w[2] for w in want)
    sf = save(spark, tmp_path, "documents", rows, "doc_id bigint, text string, lang string")
    lines = {(k, *x) for k, t, _ in rows for x in collapsed(t.split("\n"))}
    assert {tuple(r) for r in catalog.near_dup_collapse(spark, sf).collect()} == lines


def test_edit_distance_pairs(spark, tmp_path):
    head = "abcdé " * 40
    texts = [[head + "same", head + "other", "é", "e", "", "", head], [head], ["ß" * 300, "é" * 300, "é" * 299 + "x"]]
    sf = save(spark, tmp_path, "documents", [(k, "\n".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    got = {(r.media_id, r.frame): r.distance for r in catalog.edit_distance_pairs(spark, sf).collect()}
    want = {(k, i): ratio(t[i - 1], t[i]) for k, t in enumerate(texts) for i in range(1, len(t))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert 0 < got[0, 1] < 0.1 and got[2, 1] == 1


def test_wrap_text(spark, tmp_path):
    def spaced(t):
        places = [i for i, c in enumerate(t) if c == " "]
        pool = [i for i in places if i <= 36 and len(t) - i - 1 <= 36] or places
        at = min(pool, key=lambda i: (abs(i - len(t) // 2), i), default=None)
        return t if len(t) <= 36 else t[:36] + "\n" + t[36:] if at is None else t[:at] + "\n" + t[at + 1 :]

    texts = ["", "short é", "é" * 36, "é" * 37, "ab cd " * 11, "word é\nx " * 40, "x" * 500, "x" * 90 + " " + "ß" * 9, "a b" + "c" * 200]
    sf = save(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.spaced, r.cjk) for r in catalog.wrap_text(spark, sf).collect()}
    assert got == {k: (spaced(t), t if len(t) <= 18 else t[:18] + "\n" + t[18:]) for k, t in enumerate(texts)}


def test_placed_cues(spark, tmp_path):
    rng = random.Random(8)
    day = datetime.datetime(2024, 1, 1)
    rows = [(k, day + datetime.timedelta(minutes=rng.randint(0, 400)), k % 3, "view" if rng.random() < 0.7 else "click", rng.randint(1, 60) / 2) for k in range(120)]
    sf = save(spark, tmp_path, "events", rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")
    span = {r[0]: (int((r[1] - day).total_seconds() * 1000), int((r[1] - day).total_seconds() * 1000) + int(r[4] * 600_000)) for r in rows}
    want = {}
    for user in range(3):
        talk = [span[r[0]] for r in rows if r[2] == user and r[3] == "click"]
        ends = []
        for k in sorted((r[0] for r in rows if r[2] == user and r[3] == "view"), key=lambda k: (span[k][0], k % 19, k)):
            (a, b), y = span[k], k % 19 / 100
            if y < 0.2 and any(a < d and c < b for c, d in talk):
                lane = next((i for i, e in enumerate(ends) if e <= a), len(ends))
                ends[lane : lane + 1] = [b]
                y = max(y, 0.16 + 0.04 * lane)
            want[user, k] = f"{{\\an4\\pos(320,{int((1 - min(y, 1)) * 720 + 0.5)})}}sign"
    got = {(r.media_id, r.seq): r.display_text for r in catalog.placed_cues(spark, sf).collect()}
    assert got == want and any(k % 19 > 15 for _, k in got)
