"""Decontamination, ranked search and hard negatives against plain Python on small tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quakespark.llm import decontamination, hard_negatives, postings, ranked_search
from quakespark.llm.hard_negatives import Tree, Walk

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_words(text):
    return WORD.findall(lower(text))


def sentence(draw, n, vocabulary):
    return "".join(draw.choice(vocabulary) + draw.choice([" ", ", ", "\n", "-", "  "]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(5)
    common, rare = ["the", "of", "A", "in"], [f"w{i}é" for i in range(120)] + [f"Q{i}" for i in range(40)]
    items = [(i, sentence(draw, draw.choice([3, 9, 10, 11, 25, 40]), common + rare)) for i in range(30)]
    items += [(30, None), (31, ""), (32, "?!"), (33, "one"), (34, items[4][1]), (4, "twice the same identifier of another text and some more words here"), (None, "an item without any identifier that stands in no text at all x")]
    docs = []
    for i in range(220):
        text = sentence(draw, draw.choice([0, 1, 5, 30, 200]), common + rare)
        if i % 3 == 0:
            own = plain_words(items[i % 30][1])
            cut = draw.randrange(0, max(1, len(own) - 5))
            text += " ".join(own[cut:]) + sentence(draw, 7, rare)
        docs.append((draw.choice([i, i * 7]), text))
    docs += [(1000, None), (1001, ""), (1002, "..."), (None, items[7][1]), (5, docs[3][1]), (5, docs[3][1]), (6, " ".join(["One"] * 50)), (1003, "the " * 5_000 + items[9][1]), (1004, items[9][1].upper())]
    return docs, items


def frames(spark, corpus):
    docs, items = corpus
    return (
        spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, shard int").repartition(5),
        spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, phrase string"),
    )


def windows(own, size=10):
    return {tuple(own[k : k + size]) for k in range(max(1, len(own) - size + 1))} if own else set()


def test_words_of_batches_and_of_spark_are_the_same(spark, corpus):
    texts = [t for _, t in corpus[0]] + ["Ünder_score", "a b c", "x\x00y", "naïve—dash", "0 9z"]
    found, sizes = postings.batch_words(pa.array([t or "" for t in texts]))
    assert found.to_pylist() == [w for t in texts for w in plain_words(t)] and sizes.tolist() == [len(plain_words(t)) for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", postings.words(F.col("t")).alias("w")).collect()
    assert [r.w for r in sorted(rows, key=lambda r: r.i)] == [plain_words(t) for t in texts]


def test_lists_come_back(rng=random.Random(1)):
    lists = [sorted(rng.sample(range(1 << 28), n)) for n in (1, 5, 300)] + [[0], [127, 128, 16383, 16384]]
    flat, ends = np.array([x for own in lists for x in own]), np.cumsum([len(x) for x in lists])
    packed = postings.pack(postings.steps(flat, ends), ends)
    assert [np.cumsum(postings.unpack(np.frombuffer(b, dtype=np.uint8))).tolist() for b in packed.to_pylist()] == lists


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 300, "shard_docs": 7}])
def test_contamination(spark, corpus, sizes):
    docs, items = frames(spark, corpus)
    runs = {}
    for i, t in corpus[1]:
        for w in windows(plain_words(t)):
            runs.setdefault(w, set()).add(i)
    want = []
    for i, t in corpus[0]:
        own, hit, found = plain_words(t), set(), set()
        for w, names in runs.items():
            for at in range(len(own) - len(w) + 1):
                if tuple(own[at : at + len(w)]) == w:
                    hit |= set(range(at, at + len(w)))
                    found |= {str(x) for x in names if x is not None}
        want.append((i, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    for block in (50_000, 40):
        got = [tuple(r) for r in decontamination.contamination(docs, items, block=block, **sizes).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert 20 < sum(w[5] for w in want) < len(want)


def test_phrase_and_proximity_places(spark, corpus):
    docs, items = frames(spark, corpus)
    index = decontamination.build_index(docs, shard_words=2000)
    phrases = decontamination.phrases_of(items.where("item_id < 12"), 4)
    rows = phrases.select("phrase", "words").distinct().collect()
    exact, near = Counter(), 0
    for i, t in corpus[0]:
        own = plain_words(t)
        for r in rows:
            for at in range(len(own) - len(r.words) + 1):
                if own[at : at + len(r.words)] == r.words:
                    exact[i, r.phrase, at] += 1
    got = Counter(tuple(r) for r in decontamination.matches(index, phrases).collect())
    assert got == exact and exact
    texts = {i: plain_words(t) for i, t in corpus[0]}
    words_of = {r.phrase: set(r.words) for r in rows}
    found = decontamination.matches(index, phrases, reach=6).collect()
    alone = {i for i, n in Counter(i for i, _ in corpus[0]).items() if n == 1}
    for r in found:
        if r.id in alone:
            own = texts[r.id]
            assert own[r.place] in words_of[r.phrase] and words_of[r.phrase] <= set(own[max(0, r.place - 6) : r.place + 7])
            near += 1
    assert near
    close = {(i, r.phrase) for i in alone for r in rows for at, w in enumerate(texts[i]) if w in words_of[r.phrase] and words_of[r.phrase] <= set(texts[i][max(0, at - 3) : at + 4])}
    assert close <= {(r.id, r.phrase) for r in found}  # whatever the rarest word, all others are within 6 of it


def test_no_rows(spark, corpus):
    docs, items = frames(spark, corpus)
    none = decontamination.contamination(docs, items.limit(0)).collect()
    assert len(none) == len(corpus[0]) and not any(r.contaminated or r.n_hit or r.n_items for r in none)
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    assert ranked_search.ranked_search(docs.limit(0), items).count() == 0 == ranked_search.ranked_search(docs, items.limit(0)).count()


def plain_search(docs, items, k):
    texts = [(i, Counter(plain_words(t)), len(plain_words(t))) for i, t in docs]
    n, total = sum(1 for _, _, m in texts if m), sum(m for _, _, m in texts)
    df = Counter(w for _, c, _ in texts for w in c)
    out = []
    for item, t in items:
        wanted, scored = Counter(plain_words(t)), []
        for i, c, m in texts:
            length = 100 - 75 + ((75 * m * n) // total)
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * length)) for w, times in wanted.items() if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 300, "shard_docs": 7}])
def test_ranked_search(spark, corpus, sizes):
    docs, items = frames(spark, corpus)
    got = ranked_search.ranked_search(docs, items, 10, **sizes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(*corpus, 10)


def test_search_in_blocks_of_queries(spark, corpus):
    docs, items = frames(spark, corpus)
    got = ranked_search.search(ranked_search.build_index(docs), items, 3, block_words=60)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(*corpus, 3)


def test_merge_by_spans_is_a_merge():
    rng = np.random.default_rng(2)
    for _ in range(40):
        lists, total = [], Counter()
        for _ in range(rng.integers(1, 8)):
            own, factor = np.unique(rng.integers(0, 300, rng.integers(1, 120))), int(rng.integers(1, 3))
            parts = rng.integers(0, 6, len(own))
            lists.append((own, parts, factor))
            total.update({int(d): factor * int(p) for d, p in zip(own, parts, strict=True)})
        want = sorted(((-s, d) for d, s in total.items() if s > 0))[:5]
        assert sorted((-s, -d) for s, d in ranked_search.merge(lists, 5, span=16)) == want


VECTORS = "vec_id long, embedding array<float>, label int, id string"


def vector_rows(seed=3, n=700, dims=6):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=dims))], int(rng.integers(0, 4))) for i in range(n)]
    hot = [float(x) for x in np.float32(rng.normal(size=dims))]
    rows += [(5000 + i, hot, i % 2) for i in range(250)]
    rows += [(9000, None, 1), (9100, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (9200, [float("nan")] + [1.0] * (dims - 1), 2), (9300, [float("inf")] * dims, 2), (9400, [0.0] * dims, 1), (9500, [1.0, 2.0], 3), (9600, [], 3), (9700, [1.0] * dims, None), (9800, [30.0] * dims, 7), (200, [0.5] * dims, 1)]
    return rows


def plain_negatives(rows, positives=5, k=10):
    good = [(i, tuple(math.floor(256 * x) for x in v), lab) for i, v, lab in rows if v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, q, lab in good:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), i, other) for i, v, other in good)
        for p, i, _ in [x for x in scored if x[2] == lab and x[1] != a][:positives]:
            found = [(s, j) for s, j, other in scored if other != lab and 30 * -p <= 100 * -s <= 90 * -p][:k]
            out += [(a, i, rank, j, -p, -s) for rank, (s, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 64, "block": 3}])
def test_hard_negatives(spark, sizes):
    rows = vector_rows()
    table = spark.createDataFrame([(*r, "x") for r in rows], VECTORS).repartition(4)
    got = hard_negatives.hard_negatives(table, F.col("id") % 100 == 0, **sizes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    assert hard_negatives.hard_negatives(table.limit(0), F.col("id") % 100 == 0).count() == 0
    assert hard_negatives.hard_negatives(table, F.col("id") < 0).count() == 0


def test_walk_is_nearest_first_and_prunes(monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 32)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 8)) * 900
    vectors = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 8)) * 20).astype(np.int64)
    m2 = float((vectors.astype(float) ** 2).sum(axis=1).max())
    tree = Tree.grown(vectors, rng.permutation(4000), rng.integers(0, 3, 4000).astype(np.int32), m2)
    visited, takes = 0, tree.labels != 1
    for q in vectors[::400]:
        walk = Walk(tree, tree.nodes(), tree.vectors.astype(float), q.astype(float), takes)
        every = tree.vectors @ q
        top = int(every.max())
        low, high = int(0.3 * top), int(0.9 * top)
        want = sorted((-int(s), int(i)) for s, i, t in zip(every, tree.ids, takes, strict=True) if t and low <= s <= high)[:10]
        found = [x for _, x in zip(range(10), walk.nearest(low, high), strict=False)]
        assert [(-s, i) for s, i in found] == want
        visited += len(walk.leaves)
    assert visited < 0.5 * 10 * 4000 / 20  # leaves of about 31 rows
