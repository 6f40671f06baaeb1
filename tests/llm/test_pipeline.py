"""The corpus pipeline, stage by stage, against plain Python."""

import collections
import re

import corpus_pipeline

from quakespark.llm.mixing import mix
from test_ngram_join import plain_sets
from test_selection import docs

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    now = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {(r.doc_id, r.text) for r in now.collect()} if name != "best_fit_packing" else None
        out = stage(spark, now, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        if name == "best_fit_packing":
            pieces = spark.read.parquet(f"{tmp_path}/{name}").collect()
            assert {r.doc_id for r in pieces} == {r.doc_id for r in now.collect()}
            assert sum(r.piece == 0 for r in pieces) == now.count()
            break
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == columns
        kept[name] = now.collect()
        assert {(r.doc_id, r.text) for r in kept[name]} <= before
    assert {r.doc_id for r in kept["language_id"]} == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if re.search(r"[^\W\d_]", r.text or "")}
    flat = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    first = {}
    for r in sorted(kept["language_id"], key=lambda r: r.doc_id):
        first.setdefault(flat(r.text), r.doc_id)
    assert {r.doc_id for r in kept["exact_dedup"]} == set(first.values())
    rows = sorted(kept["exact_dedup"], key=lambda r: r.doc_id)
    sets = [plain_sets(r.text, 5) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if root[i] != root[j] and common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    assert {r.doc_id for r in kept["ngram_jaccard"]} == {rows[i].doc_id for i in range(len(rows)) if root[i] == i}
    taken = {r.doc_id: r for r in mix(spark.createDataFrame(kept["ngram_jaccard"], spark.read.parquet(f"{SF}/documents.parquet").schema)).collect()}
    times = collections.Counter(r.doc_id for r in kept["mixing"])
    assert all(times[i] == int(r.taken / r.size + 0.5) for i, r in taken.items())


def test_run_on_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "12 %", "a"), (4, "the the house", "a"), (4, "the the house", "a"), (5, "the  the house", None), (None, "word " * 20_000, "b"), (7, "la maison de la", "c")]
    now = docs(spark, rows).drop("lang").selectExpr("doc_id", "text", "case when doc_id = 7 then 'fr' else 'en' end AS lang", "source", "n_chars", "run", "rid")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == now.columns
        now = spark.createDataFrame(out.collect(), now.schema)
    empty = now.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
