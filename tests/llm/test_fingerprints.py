"""SpotSigs fingerprints against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quakespark.llm import spotsigs


def plain_spots(text):
    """The set of spots as strings; mirrors the definition, not the hashes."""
    words = [w for w in re.split(r"[^\w]|_", text.lower()) if w]
    common = set(spotsigs.ANCHORS)
    found = set()
    for i, w in enumerate(words):
        if w in common:
            ahead = [x for x in words[i + 1 : i + 1 + spotsigs.REACH] if x not in common]
            if len(ahead) >= spotsigs.CHAIN:
                found.add((w, *ahead[: spotsigs.CHAIN]))
    if found:
        return found
    if words:
        return {(a, b) for a, b in zip(words, [*words[1:], ""])}
    return {text} if text else set()


def plain(rows):
    rows = sorted(((i is not None, i or 0, t or "", i) for i, t in rows))
    out = []
    for k, (_, _, text, i) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][2]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = plain_spots(text), plain_spots(edited), plain_spots(after)
        near = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        out.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), round(near(a, b), 9), round(near(a, c), 9), len(a)))
    return sorted(out)


@pytest.mark.parametrize("per_range", [3, 17, 10_000])
def test_against_plain_spots(spark, per_range):
    r = random.Random(per_range)
    pool = [*spotsigs.ANCHORS[:30], "haus", "Éire", "one2", "cat", "tree", "le", "\U0001f600", "x,y", "--"]
    rows = [(r.choice([i, i * 10**12, -i]), " ".join(r.choice(pool) for _ in range(r.choice([0, 1, 2, 5, 40, 120])))) for i in range(70)]
    rows += [(500, None), (500, "the same cat tree"), (500, "the same cat tree"), (None, "of the haus cat"), (None, ""), (2**62, "the cat tree " * 20_000), (7, "!!!"), (8, "\U0001f600é" * 9)]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key int, place string")
    got = spotsigs.fingerprints(frame, rows=per_range).collect()
    assert all(x.edited_is_near == (x.near_edited >= 0.8) and x.next_is_near == (x.near_next >= 0.8) for x in got)
    size = lambda x: len(x.fingerprint.split(",")) if x.fingerprint else 0
    assert sorted((str(x.doc_id), x.n_chars, x.edited_sha256, round(x.near_edited, 9), round(x.near_next, 9), size(x)) for x in got) == plain(rows)


def test_small_and_equal(spark):
    frame = spark.createDataFrame([(1, "the cat tree of a haus")], "doc_id long, text string")
    one = spotsigs.fingerprints(frame).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert spotsigs.fingerprints(frame.where("false")).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = spotsigs.fingerprints(docs).join(docs.select("doc_id", "text"), "doc_id")
    assert got.groupBy("text").agg(F.countDistinct("fingerprint").alias("n")).where("n > 1").count() == 0
    near = got.agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert near[0] > 0.2 > near[1]
