"""The n-gram Jaccard join against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakespark.llm import ngram_join
from quakespark.llm.common import join_small
from quakespark.llm.shingles import shingles, word_hashes


def plain_sets(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)] if words else [])


def plain_components(rows, n, percent):
    sets = [plain_sets(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for i, s in enumerate(sets):
        if s:
            parent[root(i)] = root(first.setdefault(s, i))
    own = sorted(first.items(), key=lambda x: len(x[0]))
    for k, (a, i) in enumerate(own):
        for b, j in own[k + 1 :]:
            if len(a) * 100 < percent * len(b):
                break
            common = len(a & b)
            if 100 * common >= percent * (len(a) + len(b) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def edited(r, words, share):
    return [r.choice(["x", "y", "zz", "q"]) + str(r.randint(0, 50)) if r.random() < share else w for w in words]


def corpus(seed, size=260):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["The", "of", "é", "\U0001f600"]
    shared = [r.choice(vocabulary) for _ in range(60)]
    rows, bases = [], []
    for i in range(size):
        kind = r.random()
        if kind < 0.35 or not bases:
            words = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 3, 5, 12, 60, 200, 700]))]
            if r.random() < 0.3:
                words += shared
            bases.append(words)
        elif kind < 0.5:
            words = list(r.choice(bases))
        else:
            words = edited(r, r.choice(bases[:12]), r.choice([0.002, 0.01, 0.02, 0.05]))
        rows.append((r.randint(0, 10**6), r.choice([" ", "\n", "\t "]).join(words).upper() if i % 7 == 0 else " ".join(words)))
    return rows + [(5, None), (6, ""), (6, "  \n"), (7, "a b"), (8, "A  b"), (9, "a"), (9, "a"), (None, "a b"), (None, None), (11, "long " * 200_000)]


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_against_brute_force(spark, n, percent, seed, monkeypatch):
    rows = corpus(seed)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, cls string")
    got = ngram_join.ngram_jaccard(frame, n, percent).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == plain_components(rows, n, percent)


def test_groups_beyond_a_block(spark):
    rows = corpus(9, 200)
    frame = spark.createDataFrame(rows, "id long, text string")
    rule = ngram_join.Rule(3, 90)
    sets = ngram_join.shingle_sets(frame, rule)
    chosen = sets.where("n > 0").groupBy("cls").agg({"tokens": "first"}).withColumnRenamed("first(tokens)", "tokens").cache()
    groups = chosen.selectExpr("cls AS node", "0L AS root")
    parts, undivided = ngram_join.exact_links(chosen, groups, rule, 16)
    assert not undivided
    small = {tuple(x) for x in ngram_join.connected(parts, "a", "b").collect()}
    parts, undivided = ngram_join.exact_links(chosen, groups, rule, 10_000)
    whole = {tuple(x) for x in ngram_join.connected(parts, "a", "b").collect()}
    assert undivided and whole == {(x.a, x.b) for x in parts.collect()} | {(x.b, x.b) for x in parts.collect()}
    assert small == whole and len(small) > 20


def test_sample_of_documents(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for n, percent in ((3, 90), (5, 80)):
        got = ngram_join.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
        assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == plain_components(rows, n, percent)


def test_drop_near_copies(spark):
    rows = corpus(4, 120)
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int")
    kept = ngram_join.drop_near_copies(frame)
    assert kept.columns == frame.columns
    components = {(c, n > 0) for d, n, c in plain_components(rows, 5, 80) if n}
    full = [x for x in kept.collect() if plain_sets(x.text, 5)]
    assert len({x.doc_id for x in full}) >= len(components) - 1
    assert {x.doc_id for x in full} <= {c for c, _ in components} | {None}
    assert ngram_join.drop_near_copies(frame.where("false")).count() == 0 and ngram_join.ngram_jaccard(frame.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["long", "int", "double", "decimal(12,1)", "string"])
def test_identifiers_of_any_type(spark, kind):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m n o"), (4, None), (None, "a b c d e f g")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind) + (F.lit(0.5).cast(kind) if kind in ("double", "decimal(12,1)") else F.lit(0).cast(kind)) if kind != "string" else F.concat(F.lit("d"), F.col("doc_id")))
    kept = ngram_join.drop_near_copies(frame)
    number = lambda x: None if x is None else int(float(str(x).lstrip("d")))
    assert sorted(number(x.doc_id) for x in kept.collect()) == [1, 3, 4]
    found = ngram_join.ngram_jaccard(frame)
    assert sorted((number(x.doc_id) or 0, x.n_shingles, number(x.component_id)) for x in found.collect()) == [(0, 3, 1), (1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 4, 3), (4, 0, 4)]


def test_sets_of_one_class_number_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 5, 10), (2, 5, 10), (3, 5, 11), (4, 6, 10), (5, 6, 10)], "id long, cls long, sure long")
    shared = ngram_join.clashes(rows)
    assert [x.cls for x in shared.collect()] == [5]
    got = {x.id: x.cls for x in ngram_join.apart(rows, shared).collect()}
    assert got[1] == got[2] != got[3] and got[4] == got[5] == 6 and len(set(got.values())) == 3
    assert ngram_join.apart(rows, shared).columns == rows.columns


def test_unbroken_text_and_a_hot_shingle(spark):
    r = random.Random(12)
    rows = [(0, "x" * 3_000_000), (1, "x" * 3_000_000), (2, "y" * 3_000_000)]
    hot = "these three words"
    rows += [(10 + i, hot + " " + " ".join(f"v{r.randint(0, 10**6)}" for _ in range(2))) for i in range(3000)]
    base = [f"b{i}" for i in range(40)]
    rows += [(5000 + i, " ".join([*base[:38], f"e{i}", base[39]])) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in ngram_join.ngram_jaccard(frame, 3, 80).collect()}
    assert [got[i].component_id for i in (0, 1, 2)] == [0, 0, 2] and got[0].n_shingles == 1
    assert {got[5000 + i].component_id for i in range(600)} == {5000}
    small = [x for x in rows if 10 <= x[0] < 10 + 3000]
    sets = {i: plain_sets(t, 3) for i, t in small}
    assert all(got[i].n_shingles == len(sets[i]) and got[i].component_id == i for i, _ in small)


def test_prefixes_lose_no_pair():
    r = random.Random(3)
    for percent in (60, 80, 90, 95):
        rule = ngram_join.Rule(3, percent)
        for _ in range(3000):
            a, b, c = r.randint(0, 60), r.randint(0, 6), r.randint(0, 6)
            one, other = a + b, a + c
            if not a or 100 * a < percent * (a + b + c):
                continue
            assert a >= rule.needed(one, other) and a >= rule.least_overlap(one)
            order = list(range(a + b + c))
            r.shuffle(order)
            x, y = {i for i in order if i < a + b}, {i for i in order if i < a or i >= a + b}
            first = lambda s: {i for i in [i for i in order if i in s][: rule.prefix(len(s))]}  # noqa: E731, B023
            common = len(first(x) & first(y))
            assert common >= max(rule.enough(one), rule.enough(other), 1)


def test_word_hashes_equal_words():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("abAB é\n\t\x0b\x1c ") for _ in range(r.randint(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        own = word_hashes(np.frombuffer(text.encode(), dtype=np.uint8)).tolist()
        assert len(own) == len(words) and len(set(own)) == len(set(words)) and all((a == b) == (x == y) for a, x in zip(own, words) for b, y in zip(own, words))
    text = ("word " * 70_000 + "z" * 600_000 + " word tail").encode()
    own = word_hashes(np.frombuffer(text, dtype=np.uint8))
    assert len(own) == 70_003 and own[0] == own[-2] and len(np.unique(own)) == 3
    assert len(shingles(own, 3)) == 4


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_repeated_rows_are_not_sent_through_the_driver(spark, tmp_path, how):
    """A side of over 400,000 short rows: its file is small enough for Spark to broadcast all that it is repeated to."""
    spark.range(400_001).write.parquet(f"{tmp_path}/right")
    joined = join_small(spark.range(500_000, 2_500_000).selectExpr("id - 100001 AS id", "id AS own"), spark.read.parquet(f"{tmp_path}/right"), ["id"], how)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == {"inner": 2, "left": 2_000_000, "left_semi": 2, "left_anti": 1_999_998}[how]


def test_sides_of_many_rows_stay_on_the_executors(spark, monkeypatch):
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda frame: (sent.append(frame.count()), broadcast(frame))[1])
    n = 120_000
    nodes = spark.range(n).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 3).alias("b"))
    groups = ngram_join.settle(ngram_join.connected(nodes, "a", "b"), "groups")
    assert groups.count() == n and groups.where("root <> node - node % 3").count() == 0
    tokens = F.unhex(F.sha2(F.floor(F.col("id") / 3).cast("string"), 256))
    sets = spark.range(2 * n, numPartitions=4).select(F.col("id").alias("cls"), tokens.alias("tokens"))
    chosen = ngram_join.settle(ngram_join.candidate_sets(sets.unionByName(sets), groups.select(F.col("node").alias("cls"))), "chosen")
    assert chosen.count() == n and chosen.join(sets, ["cls", "tokens"]).where(f"cls < {n}").count() == n
    links, whole = ngram_join.exact_links(chosen, groups, ngram_join.Rule())
    assert whole and {(x.a, x.b) for x in links.collect()} == {(i, i - i % 3) for i in range(n) if i % 3}
    assert max(sent) <= 100_000
