"""Personal data: base patterns, the semi-Markov field against enumeration, and whole rows."""

import hashlib
import itertools
import math
import random
import re
import time

from quakespark.llm import pii


def plain_base(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans():
    r = random.Random(3)
    pool = ["a.b@c-d.com", "x@y", "@", "1.2.3.4.5", "256.1.1.1", "0001.2.3.004", "4465758382889437", "4465 7583-8288 9437", "4465  7583", "+1 (743) 555-3824", "+49.30.1234567", "+1 2", "+", "12", "é", "\U0001f600", " ", ".", "-", "(", "word", "99999999999999999999999999", "00000000000000"]
    for _ in range(3000):
        text = "".join(r.choice(pool) + r.choice(["", " ", ","]) for _ in range(r.randint(0, 8)))
        assert pii.base_spans(text) == plain_base(text), text


def test_sums_and_best_path_against_enumeration():
    r = random.Random(4)
    for text in ("(743) 555-3824", "a 10[.]2[.]3[.]4", "x (at) host.com", "555 123 4567 8"):
        n, own = pii.segments(text)
        weights = {f: r.uniform(-1, 1) for s in own for f in s[5]}
        paths, ways = [], [[] for _ in range(n + 1)]
        ways[0] = [()]
        for j in range(1, n + 1):
            ways[j] = [w + (k,) for k, s in enumerate(own) if s[1] == j for w in ways[s[0]]]
        paths = ways[n]
        scores, post = pii.marginals(n, own, weights)
        total = sum(math.exp(sum(scores[k] for k in w)) for w in paths)
        for k in range(len(own)):
            assert abs(post[k] - sum(math.exp(sum(scores[q] for q in w)) for w in paths if k in w) / total) < 1e-9
        best = pii.best_path(n, own, scores)
        assert abs(sum(scores[k] for k in best) - max(sum(scores[k] for k in w) for w in paths)) < 1e-9
        assert list(itertools.chain(*[range(own[k][0], own[k][1]) for k in best])) == list(range(n))


def test_field_on_unseen_examples():
    weights = pii.fit(pii.written_examples())
    right = total = wrong = clean = 0
    for text, gold in pii.written_examples(seed=1234):
        base = pii.base_spans(text)
        if base:
            continue
        got = pii.added_spans(text, base, weights)
        if gold:
            total += 1
            right += got == gold
        else:
            clean += 1
            wrong += bool(got)
    assert right / total > 0.85 and wrong / clean < 0.05


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "mail a@b.co or +1 (743) 555-3824."), (3, "mail a@b.co or +1 (743) 555-3824."), (None, "1.2.3.4"), (5, "no numbers here"), (6, "é\U0001f600 " + "word " * 50_000 + "4465758382889437"), (7, "1 2 3 " * 30_000), (8, "call (743) 555-3824 now")]
    frame = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string")
    got = pii.find_pii(frame).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        base = plain_base(t or "")
        want[i] = ([sum(k == kind for k, _, _ in base) for kind in pii.KINDS], ",".join(f"{k}:{s}:{e}" for k, s, e in base))
    for x in got:
        counts, text = want[x.doc_id]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == counts and x.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(filter(None, x.spans.split(",")))
    by = {x.doc_id: x.spans for x in got}
    assert by[8] == "phone:5:19" and by[5] == "" == by[7] and by[6].startswith("card:")
    assert pii.mask(rows[2][1], by[3]) == "mail <email> or <phone>."
    assert pii.find_pii(frame.where("false")).count() == 0


def test_clean_documents_stay_clean(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for x in pii.find_pii(docs).join(docs, "doc_id").collect():
        assert x.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in plain_base(x.text)).encode()).hexdigest()
        assert re.search("[0-9@]", x.text) or not x.spans


def test_what_is_left_beside_base_spans_is_scored():
    weights = pii.fit(pii.written_examples())
    found = lambda t: {t[s:e] for _, s, e in pii.added_spans(t, pii.base_spans(t), weights)}
    assert found("host 10.0.0.5 415-555-2671") == {"415-555-2671"}
    assert found("415-555-2671 10.0.0.5 617.555.0143") == {"415-555-2671", "617.555.0143"}
    assert {t for _, t, _ in pii.stretches("a 10.0.0.5 b", [("ip", 2, 10)])} == set()


def test_long_written_forms_are_one_segment():
    weights = pii.fit(pii.written_examples())
    for kind, text in (("ip", "10 (dot) 2 (dot) 3 (dot) 4"), ("email", "john.smith (at) example (dot) co (dot) uk")):
        whole = f"host {text}" if kind == "ip" else f"mail {text}"
        assert pii.added_spans(whole, pii.base_spans(whole), weights) == [(kind, 5, len(whole))], whole


def test_base_spans_of_any_characters():
    r = random.Random(13)
    for _ in range(6000):
        text = "".join(r.choice("ab1@..-+%_ é19") for _ in range(r.randint(0, 24)))
        assert pii.base_spans(text) == plain_base(text), text
    for _ in range(3000):
        text = "".join(r.choice("12345.... 0") for _ in range(r.randint(0, 30)))
        assert pii.base_spans(text) == plain_base(text), text


def test_long_unbroken_texts_end():
    weights = pii.fit(pii.written_examples())
    for text in ("a" * 10**6, "a" * 10**6 + " @", "7" * 300_000, "a" * 10**6 + " (at) x.com", "1." * 300_000, "a@" * 300_000, "+1" * 300_000, "a1" * 500_000, "é" * 10**6, "@ " * 300_000):
        start = time.process_time()
        pii.find_all(text, weights)
        assert time.process_time() - start < 12, text[:10]


def test_secrets_in_unseen_forms():
    weights, r = pii.fit(pii.written_examples()), random.Random(99)
    code = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n - 2)) + "b3"
    key = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n - 1)) + "4"
    found = total = wrong = clean = 0
    for _ in range(300):
        lead, body = r.choice([("and password=", code(18)), ('der token = "', code(40)), ("que AKIA", key(16)), ("passwd: ", code(20))])
        body = "AKIA" + body if lead.endswith("AKIA") else body
        text = lead.removesuffix("AKIA") + body + r.choice(['"', " ones.", ""])
        total += 1
        found += ("secret", text.index(body), text.index(body) + len(body)) in pii.added_spans(text, [], weights)
    for _ in range(300):
        text = r.choice(["commit " + code(40), "the file " + "/".join("".join(r.choice("abcdef") for _ in range(7)) for _ in range(3)) + "12 of it", "Rechtsschutzversicherungsgesellschaften 2024", "a well-known-state-of-the-art-2 thing"])
        clean += 1
        wrong += bool(pii.added_spans(text, [], weights))
    assert found / total > 0.95 and wrong / clean < 0.02
