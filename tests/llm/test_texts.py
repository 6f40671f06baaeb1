"""Language, license and line operators against plain Python on small tables and held-out rows."""

import collections
import math
import random
import re
import zlib

import regex
from pyspark.sql import functions as F

from quakespark.llm import language, licenses
from quakespark.llm.line_dedup import LONG, drop_repeated_lines, drop_repeated_passages

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_on_held_out_rows(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    right = total = 0
    for r in rows:
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (g.lang_pred == "und") == (not regex.search(r"\p{L}", r.text or "")) and 0 <= g.score <= 1
        if g.held_out and r.lang and g.lang_pred != "und":
            total += 1
            right += g.lang_pred == r.lang
    assert total > 20 and right / total > 0.95


def test_language_learns_nothing_from_held_out_rows(spark):
    docs = documents(spark).limit(120)
    rows = [r.asDict() for r in docs.collect()]
    changed = [r | ({"lang": "xx"} if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 else {}) for r in rows]
    frame = lambda x: spark.createDataFrame(x, docs.schema)
    assert sorted(map(str, language.identify(frame(rows)).collect())) == sorted(map(str, language.identify(frame(changed)).collect()))


def plain_languages(rows):
    """doc_id -> (lang_pred, score), counted and scored in plain Python over (doc_id, text, lang)."""
    words = lambda text: regex.findall(r"[\p{L}\p{M}]+", (text or "").lower())
    counts = collections.Counter()
    for i, text, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts.update((lang, w) for w in words(text))
    languages = sorted({lang for lang, _ in counts})

    def scores(table, limit):
        total = collections.Counter()
        for (_, key), n in table.items():
            total[key] += n
        kept = sorted(total, key=lambda k: (-total[k], k))[:limit]
        sums = {lang: sum(table[lang, k] + language.SMOOTHING for k in kept) for lang in languages}
        out = {}
        for k in kept:
            logs = [math.log((table[lang, k] + language.SMOOTHING) / sums[lang]) for lang in languages]
            out[k] = [max(-language.STEP, min(language.STEP, x - sum(logs) / len(logs))) for x in logs]
        return out

    known, grams = scores(counts, language.WORDS), {}
    for size in range(1, language.LONGEST + 1):
        table = collections.Counter()
        for (lang, w), n in counts.items():
            for at in range(len(w) + 3 - size):
                table[lang, f" {w} "[at : at + size]] += n
        grams |= scores(table, language.GRAMS)
    share = [sum(n for (lang, _), n in counts.items() if lang == own) for own in languages]

    def predict(text):
        if not languages or not regex.search(r"\p{L}", text or ""):
            return "und", 0.0
        sums, weight = [0.0] * len(languages), 0.0
        for w in words(text):
            if w in known:
                parts, own = [known[w]], 1.0
            else:
                padded = f" {w} "
                sizes = [next((s for s in range(language.LONGEST, 0, -1) if padded[at : at + s] in grams), 0) for at in range(len(w) + 1)]
                parts = [grams[padded[at : at + s]] for at, s in enumerate(sizes) if s]
                own = max(1.0, len(parts) / language.LONGEST)
            weight += own
            for part in parts:
                sums = [a + own / len(parts) * b for a, b in zip(sums, part, strict=True)]
        sums = [a * min(1.0, math.sqrt(25 / max(1.0, weight))) + 0.1 * math.log(n / sum(share)) for a, n in zip(sums, share, strict=True)]
        odds = [math.exp(x - max(sums)) for x in sums]
        best = odds.index(max(odds))
        return languages[best], odds[best] / sum(odds)

    return {i: predict(text) for i, text, _ in rows}


def test_language_against_plain_counts(spark):
    docs = documents(spark).select("doc_id", "text", "lang").limit(150)
    rows = [tuple(r) for r in docs.collect()] + [(-k, t, None) for k, t in enumerate(["\u00bd", "qzx vvw", "\u65e5\u672c", "the xqthe \u201cunter\u201d", "1 2 3"], 1)]
    wanted = plain_languages(rows)
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, docs.schema)).collect()}
    assert len({lang for lang, _ in wanted.values()}) > 3 and set(got) == set(wanted)
    for i, (lang, score) in wanted.items():
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-4, i


def test_language_ties_go_to_the_first_by_code_point(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2][:4]
    rows = [(ids[0], "uno dos", "b"), (ids[1], "uno dos", "a"), (ids[2], "uno", None), (ids[3], "xyz", None), (ids[3], "xyz", None)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 5 and {(r.lang_pred, round(r.score, 6)) for r in got} == {("a", 0.5)} and plain_languages(rows)[ids[2]] == ("a", 0.5)


def test_language_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string, found int"
    rows = [(1, None, "en", "a", 1), (2, "", "en", "a", 1), (3, "123 $$", None, "a", 1), (3, "the the of", "en", "a", 1), (4, "le la des", "fr", "a", 1), (None, "the", None, "a", 1), (6, "the " * 50_000, "en", "b", 2), (8, "日本語", None, "b", 2)]
    frame = spark.createDataFrame(rows, schema)
    got = language.identify(frame).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert all(r.lang_pred == "und" and r.score == 0 for i in (1, 2) for r in by[i]) and by[4][0].lang_pred == "fr" and by[6][0].lang_pred == "en"
    kept = language.drop_unidentified(frame)
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "6", "8", "None"]
    assert language.identify(frame.where("false")).count() == 0
    assert {r.lang_pred for r in language.identify(frame.withColumn("lang", frame.lang.substr(99, 1)).where("lang is null")).collect()} <= {"und"}


def test_unseen_words_back_off_to_shorter_grams():
    import numpy as np

    model = language.Model(["a", "b"], {}, {"xyz": 0, "q": 1}, np.zeros((0, 2), np.float32), np.array([[2.0, -2.0], [-1.0, 1.0]], np.float32), np.zeros(2, np.float32))
    assert language.longest_grams(model.grams, "xyzq") == [0, 1] and language.longest_grams(model.grams, "kkk") == []
    assert language.Scorer(model)("xyz xyz")[0] == "a" and language.Scorer(model)("q")[0] == "b"


def test_runs_without_spaces_are_read_whole():
    import numpy as np

    model = language.Model(["en", "zh"], {b"the": 0}, {"\u597d": 0}, np.array([[2.0, -2.0]], np.float32), np.array([[-2.0, 2.0]], np.float32), np.zeros(2, np.float32))
    assert language.longest_grams(model.grams, "x" * 100 + "\u597d" * 5) == [0] * 5
    score = language.Scorer(model)
    assert score("the the the the the " + "\u597d" * 200)[0] == "zh" and score("the the the \u597d")[0] == "en"
    assert score("\u201cthe\u201d")[0] == "en"


def test_language_learns_beyond_the_start_of_runs_and_rare_labels(spark):
    rows = [(f"{'x' * 80}q{k}", "a") for k in ("", "")] + [("x" * 80 + "z", "b")] + [(f"w{i}", f"l{i}") for i in range(220)]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 222 and {"xq", "xz", "xxxq"} <= set(model.grams)
    frame = spark.createDataFrame([("\u4f60\u597d\u3002\u4e16\u754c\uff0c\u201cabc\u201d \u0939\u093f",)], "text string")
    assert frame.select(language.letters(frame.text)).first()[0] == language._WORD.findall(frame.first().text) == ["\u4f60\u597d", "\u4e16\u754c", "abc", "\u0939\u093f"]


def plain_scan(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_scan_against_plain_matching(spark):
    r = random.Random(4)
    pool = ["GNU", "general", "public", "License", "apache", "cc", "by", "mit", "é", "x9", "MIT-License", "CC_BY", "gnu General\tPublic  license.", "\x00", "İ", "a b"]
    texts = [None, "", "mit license mit license", "MIT LICENSE", *(" ".join(r.choice(pool) for _ in range(r.randint(0, 30))) for _ in range(300)), "word " * 50_000 + "cc by"]
    texts += [x.text for x in documents(spark).collect()]
    frame = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {x.doc_id: x for x in licenses.scan(frame).collect()}
    for i, t in enumerate(texts):
        g = got[i]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == plain_scan(t), t
        assert set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(",")))
    assert licenses.scan(frame.where("false")).count() == 0


def test_templates():
    scan = licenses.Scanner()
    labels = lambda t: scan(t)[5]
    assert labels("Licensed under the Apache License, Version 2.0.") == "apache,apache-2.0"
    assert labels("Licensed under the Apache License 2.0") == "apache,apache-2.0"
    assert labels("Licensed under the Apache License, Version 1.1.") == "apache"
    assert labels("is licensed under the GNU General Public License, version 3.") == "gpl,gpl-3.0-only"
    assert labels("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version") == "gpl,gpl-3.0-or-later"
    assert labels("under the GNU General Public License version 3 or newer") == "gpl,gpl-3.0-or-later" and labels("under the GNU General Public License version 3 or something") == "gpl"
    assert labels("under the terms of the GNU GPL. Under the GNU General Public License version 2.0 or later. Under the GNU General Public License, version 2 only, it says.") == "gpl,gpl-2.0-only,gpl-2.0-or-later"
    assert labels("under the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.") == "lgpl-2.1-or-later"
    assert labels("under the GNU General Public License version 2.1 only") == labels("under the GNU General Public License, version 2.0.1") == "gpl"
    assert labels("under the GNU General Public License version 3+") == labels("the GNU General Public License (GPL) or the General Public License v3.0+.") == "gpl,gpl-3.0-or-later"
    assert labels("GNU Lesser General Public License v2.1") == "lgpl-2.1-only" and labels("General Public License v3") == "gpl-3.0-only" and labels("GNU Affero General Public License version 3+") == "agpl-3.0-or-later"
    assert labels("GNU Lesser General Public License v2.12") == labels("General Public License v33") == labels("General Public License. 3 people") == ""
    head = "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    assert labels(head) == "gpl,gpl-3.0-text" and labels(head.replace("not allowed", "allowed")) == "gpl" and labels(head.replace("GNU", "GNU LESSER")) == "lgpl-3.0-text"
    assert labels("// SPDX-License-Identifier: GPL-2.0-or-later") == "gpl-2.0-or-later" and labels("SPDX-License-Identifier: MIT") == "mit-notice" and labels("SPDX-License-Identifier: Apache-2.0") == "apache-2.0" and labels("SPDX-License-Identifier: Apache-2.0.1") == ""
    assert scan("version 3+ of a+b 1+2")[:2] == (7, 0)
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
    THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
    assert labels(mit) == "mit-text" and labels(mit.replace("sublicense", "sell")) == "" and labels(mit[:400]) == ""
    own = licenses.Scanner({}, [("x", "go ((left|right)) now !(or)"), ("y", "go ((left|right)) now or later")])
    assert [own(t)[5] for t in ("go left now", "go right now and", "go up now", "go left now or", "go left now or later", "go left now. go right now or later")] == ["x", "x", "", "", "y", "x,y"]
    assert licenses.longest([(0, 5, "a"), (1, 4, "b"), (0, 5, "c"), (2, 9, "d"), (6, 9, "e")]) == {"a", "c", "d"}
    own = licenses.Scanner({}, [("x", "open the {{2-3}} door [[now [[please]]]] end")])
    yes = ["open the a b door end", "open the a b c door end", "open the a b door now end", "open the door door door door now please end", "z open the open the a b door end"]
    no = ["open the a door end", "open the a b c d door end", "open the a b door please end", "open the a b door now please", "open the"]
    assert all(own(t)[5] == "x" for t in yes) and not any(own(t)[5] for t in no)


def test_template_automaton_against_regular_expressions():
    r = random.Random(8)
    for _ in range(300):
        markup, pattern = "s ", r"s "
        for _ in range(r.randint(1, 6)):
            kind, word = r.choice("lov"), r.choice("abc")
            if kind == "l":
                markup, pattern = markup + word + " ", pattern + word + " "
            elif kind == "o":
                markup, pattern = markup + f"[[{word} a]] ", pattern + f"(?:{word} a )?"
            else:
                n = r.randint(0, 2)
                markup, pattern = markup + f"{{{{{n}-{n + r.randint(0, 2)}}}}} ", pattern
                lo, hi = re.findall(r"\{\{(\d)-(\d)", markup)[-1]
                pattern += f"(?:\\w+ ){{{lo},{hi}}}"
        automaton = licenses.Automaton("x", markup)
        for _ in range(40):
            words = ["s", *(r.choice("abcs") for _ in range(r.randint(0, 8)))]
            want = re.match(pattern, " ".join(words) + " ")
            opened = 0 in licenses.places(f" {' '.join(words)} ".encode(), automaton.opening)
            assert (opened and automaton.run([w.encode() for w in words], 0) >= 0) == bool(want), (markup, words)


def plain_lines(rows):
    import hashlib

    seen, out = {}, {}
    for key in sorted({(i is None, i or 0, t or "") for i, t in rows}):
        lines = key[2].split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        bit = [(x + 31 * (h[k - 1] if k else 0)) // 1024 % 2 for k, x in enumerate(h)]
        chunks = [[]]
        for k, x in enumerate(lines):
            chunks[-1].append(x)
            if 0 < k < len(lines) - 1 and not bit[k] and bit[k - 1]:
                chunks.append([])
        kept, gone = [], 0
        for c in chunks:
            if len(c) > 1 and tuple(c) in seen:
                gone += 1
            else:
                seen[tuple(c)] = 1
                kept += c
        out[key] = (len(lines), len(lines) - len(kept), gone, "\n".join(kept))
    return out


def test_line_dedup_against_plain_chunks(spark):
    r = random.Random(6)
    pool = [f"line {i} of some text" for i in range(30)]
    passage = [f"passage {i}" for i in range(20)]
    rows = []
    for i in range(150):
        lines = [r.choice(pool) for _ in range(r.randint(0, 12))]
        if i % 3 == 0:
            at = r.randint(0, len(lines))
            lines[at:at] = passage
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n"), (203, "\n\n\n"), (None, "\n".join(passage)), (204, rows[0][1]), (204, rows[0][1]), (205, "one line " * 20_000)]
    frame = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, row int, chunk string")
    want = plain_lines(rows)
    got = drop_repeated_lines(frame).collect()
    assert sorted((str(x.doc_id), x.n_lines, x.n_removed, x.removed_chunks, x.text) for x in got) == sorted((str(i), *want[i is None, i or 0, t or ""]) for i, t in rows)
    assert sum(x.n_removed for x in got) > 500
    assert drop_repeated_lines(frame.where("false")).count() == 0


def plain_passages(rows):
    seen, out = set(), {}
    for key in sorted({(i is None, i or 0, t or "") for i, t in rows}):
        lines = key[2].split("\n")
        lost = set()
        for k, x in enumerate(lines):
            own = [(x,)] if len([w for w in re.split(r"[ \t-\r]+", x) if w]) >= LONG else []
            own += [(x, lines[k + 1])] if k + 1 < len(lines) else []
            for passage in own:
                if passage in seen:
                    lost |= set(range(k, k + len(passage)))
                seen.add(passage)
        runs = sum(k - 1 not in lost for k in lost)
        out[key] = (len(lines), len(lost), runs, "\n".join(x for k, x in enumerate(lines) if k not in lost))
    return out


def test_passages_of_two_to_five_lines_are_found(spark):
    r = random.Random(9)
    passages = [[f"passage {n} line {k} " + "word " * 20 for k in range(n)] for n in (2, 3, 4, 5)] + [["one long line " * 20]]
    rows = []
    for i in range(100):
        lines = [f"own line {i} {k}" for k in range(4)]
        at = r.randint(0, 4)
        lines[at:at] = passages[i % 5]
        rows.append((i, "\n".join(lines)))
    pool = [f"line {i}" for i in range(8)]
    rows += [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 9)))) for i in range(100, 200)]
    rows += [(200, None), (201, ""), (202, "\n\n\n"), (None, rows[0][1]), (204, rows[1][1]), (204, rows[1][1]), (205, "a\na\na"), (206, "w " * 20_000), (207, "w " * 20_000)]
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, lost int")
    want, got = plain_passages(rows), drop_repeated_passages(frame).collect()
    assert sorted((str(x.doc_id), x.n_lines, x.n_removed, x.removed_passages, x.text) for x in got) == sorted((str(i), *want[i is None, i or 0, t or ""]) for i, t in rows)
    planted = sum(len(passages[i % 5]) for i in range(5, 100))
    count = lambda rows: sum(x.n_removed for x in rows if x.doc_id is not None and x.doc_id < 100)
    assert count(got) == planted and count(drop_repeated_lines(frame).collect()) < planted / 2
    assert drop_repeated_passages(frame.where("false")).count() == 0


def test_numerals_are_no_letters(spark):
    rows = [(i, f"the words of {i} and that", "en") for i in range(20)] + [(100 + i, t, "en") for i, t in enumerate(["\u00bd", "\u2461 \u00b2", "\u2167", "12 34", "\u00aa", "\u00bd a"])]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(table).collect()}
    assert [got[100 + i] for i in range(6)] == ["und", "und", "und", "und", "en", "en"]
    assert {r.doc_id for r in language.drop_unidentified(table).collect()} == {i for i in range(20)} | {104, 105}


def test_labels_follow_sure_predictions(spark):
    docs = documents(spark).select("doc_id", "text", "lang").withColumn("_found", F.lit(1))
    kept = [i for i in range(10**6, 10**6 + 400) if zlib.crc32(str(i).encode()) % 4 == 2][:3]
    text = {r.lang: r.text for r in docs.where("length(text) > 400").collect() if r.lang}
    a, b = sorted(text)[:2]
    extra = spark.createDataFrame([(kept[0], text[a], None, 2), (kept[1], text[a], b, 2), (kept[2], "12 34", b, 2), (kept[0], text[a], None, 2)], docs.schema)
    table = docs.unionByName(extra)
    found = language.label_languages(table)
    assert found.columns == table.columns and found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython ") == 1
    got = [r for r in found.where("_found = 2").collect()]
    assert sorted((r.doc_id, r.lang) for r in got) == sorted([(kept[0], a), (kept[0], a), (kept[1], a)])
    told = {r.doc_id: r for r in language.identify(table).collect()}
    for r in found.where("_found = 1").join(docs.select("doc_id", F.col("lang").alias("own")), "doc_id").collect():
        want = told[r.doc_id].lang_pred if r.own is None or told[r.doc_id].score >= language.SURE else r.own
        assert r.lang == want
    assert language.label_languages(table.where("false")).count() == 0
