"""The pipeline against a brute-force version, stage by stage, and the queries against their SQL."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from cuemill.llm import queries
from cuemill.llm._core import staged

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "test-stage")
        out.append(docs)
        if len(out) < 5:
            assert docs.columns == columns
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in out]
    known = [i for i in texts if i in labels]
    assert sum((i in ids[0]) == (labels[i] == 1) for i in known) >= 0.95 * len(known)

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(texts[i]) for i in ids[0]}
    group = {i: i for i in ids[0]}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    assert ids[1] == set(group.values())

    def plain(t):
        return " " + " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())) + " "

    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids[2] == {i for i in ids[1] if not any(x in plain(texts[i]) for x in items)}
    assert ids[3] == ids[2]
    assert not [r for r in out[3].collect() if re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r.text)]
    mixed = out[4].agg(F.sum("taken"), F.max(F.col("taken") - 2 * F.col("size"))).first()
    assert mixed[1] <= 0 and mixed[0] > 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
