"""Exact dedup, mixing, packing and archives against plain Python on small tables."""

import collections
import hashlib
import json
import random
import re
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from quakespark.llm import mixing, packing, tokens, warc
from quakespark.llm.common import settle
from quakespark.llm.exact_dedup import drop_copies, exact_copies
from quakespark.llm.tokens import encoder, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, run int, rid string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, 1, "x") for i, t, s in rows], DOCS)


ODD = [(5, "a  b\tc", "s1"), (3, "a b c", "s1"), (9, None, "s2"), (2, "", None), (7, "only", None), (7, "only", None), (7, "other", "s3"), (None, "only", "s1"), (None, "none else", "s1"), (11, "word " * 9000, "s2"), (12, "éà \U0001f600", "s2")]


def plain_dedup(rows):
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        for i in ids:
            out.append((i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_copies(spark):
    rows = ODD + [(100 + i, "copied text", "s4") for i in range(300)]
    got = exact_copies(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain_dedup(rows)
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in got})
    assert all(r.keep_id == r.doc_id for r in got if r.kept)


def test_drop_copies_keeps_one_of_each(spark):
    rows = ODD + [(100 + i, "copied text", "s4") for i in range(50)]
    got = drop_copies(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in got.collect()]
    assert len(texts) == len(set(texts)) == len(plain_dedup(rows) and {x[3] for x in plain_dedup(rows)})


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_copies(none).count() == 0 and drop_copies(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.repeat_mixed(none).count() == 0
    assert packing.pack(none).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix_against_plain_resharing(spark):
    r = random.Random(5)
    rows = [(i, "w " * r.choice([0, 1, 50, 300, 4000]), r.choice(["a", "b", "b", "b", "c", "dé", "z", None])) for i in range(400)] + ODD
    got = mixing.mix(docs(spark, rows), shard_words=20_000).collect()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    target, taken, source = plain_targets(size), collections.Counter(), collections.defaultdict(set)
    for (i, t, s) in rows:
        source[i].add(s)
    assert len(got) == len(rows)
    by_target = collections.Counter()
    for x in got:
        assert 0 <= x.taken <= 2 * x.size
        by_target[round(x.target, 6)] += x.taken
    for s, t in target.items():
        assert any(abs(x.target - t) < 1e-6 and x.source_size == size[s] for x in got if s in source[x.doc_id])
    wanted = collections.Counter()
    for t in target.values():
        wanted[round(t, 6)] += t
    assert all(abs(by_target[k] - v) <= 40 + 0.01 * v for k, v in wanted.items())
    again = mixing.mix(docs(spark, rows[::-1]).repartition(5), shard_words=20_000).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_rows_repeat_as_mix_takes_them(spark):
    r = random.Random(8)
    rows = [(i, f"t{i} " + "w " * r.choice([0, 1, 50, 300, 2000]), r.choice(["a", "b", "b", "b", "c", "dé", None])) for i in range(500)] + [(900, None, "a"), (901, " \t", "b"), (None, "no id here", "c")]
    schema = "doc_id long, text string, source string, _times int, _shard string, _order long"
    frame = spark.createDataFrame([(*x, 7, "s", None) for x in rows], schema)
    taken = {x.doc_id: (x.taken, x.size) for x in mixing.mix(frame, shard_words=9000).collect()}
    got = mixing.repeat_mixed(frame, shard_words=9000)
    assert got.columns == frame.columns
    found = got.collect()
    times = collections.Counter(x.doc_id for x in found)
    for i, (t, size) in taken.items():
        assert times[i] == (int(t / size + 0.5) if size else 0), i
    assert all((x._times, x._shard, x._order) == (7, "s", None) for x in found) and len(set(times.values())) == 2
    twice = spark.createDataFrame([(1, "same row", "a", 0, "s", None)] * 3 + [(2, "other words here", "a", 0, "s", None)], schema)
    assert set(collections.Counter(x.doc_id for x in mixing.repeat_mixed(twice).collect()).values()) <= {1, 2, 3, 6}


def test_sainte_lague_against_highest_quotients(spark):
    r = random.Random(2)
    parties = [(g, k, float(r.choice([0, 1, 5, 30, 1000, 7.5]))) for g in range(30) for k in range(r.randint(1, 12))]
    seats = {g: r.choice([0, 1, 3, 17, 400]) for g in range(30)}
    frame = spark.createDataFrame([(g, k, v, seats[g]) for g, k, v in parties], "g int, k int, v double, s long")
    got = {(x.g, x.k): x.quota for x in mixing.apportion(frame, ["g"], ["k"], "v", F.col("s")).collect()}
    for g in range(30):
        own = [(k, v) for h, k, v in parties if h == g]
        won = collections.Counter()
        for _ in range(seats[g] if sum(v for _, v in own) else 0):
            won[max(own, key=lambda x: (x[1] / (2 * won[x[0]] + 1), -x[0]))[0]] += 1
        assert {k: got[g, k] for k, _ in own} == {k: won[k] for k, _ in own}


@pytest.mark.parametrize("seed", range(60))
def test_plan_fills_every_slot_once(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 20, 64, 4096])
    histogram = {r.randint(1, capacity): r.choice([1, 2, 3, 5, 17, 100]) for _ in range(r.randint(1, 60))}
    sequences, ranks = collections.defaultdict(list), collections.defaultdict(set)
    for length, low, high, first, offset in packing.plan(histogram, capacity):
        for k in range(low, high):
            assert k not in ranks[length]
            ranks[length].add(k)
            sequences[first + k - low].append((offset, length))
    assert {k: len(v) for k, v in ranks.items()} == histogram
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    # First-fit decreasing, document by document, is no better than a sequence or so.
    rooms = []
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        at = next((i for i, x in enumerate(rooms) if x >= length), None)
        rooms.append(capacity - length) if at is None else rooms.__setitem__(at, rooms[at] - length)
    assert len(sequences) <= 1.02 * len(rooms) + 1


def test_pack_is_gapless_and_exact(spark):
    rows = [*ODD, (20, "<|endoftext|> It's ΣΑΣ café, naïve. é x\x1cy", "s"), *[(30 + i, "some words here", "s") for i in range(40)]]
    got = packing.pack(docs(spark, rows)).collect()
    whole = encoder(tokenizer_path()).tokenizer
    want = []
    for i, t, _ in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want.append((i, piece, start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


@pytest.mark.parametrize("store", [20, 500_000])
def test_encoder_equals_whole_encoding(monkeypatch, store):
    monkeypatch.setattr(tokens, "STORE", store)
    own, r = tokens.Encoder(tokenizer_path()), random.Random(3)
    letters = "abcDEFzéÉßüµª.,'’!?09 \n\t\r\x0b\x1ćİΣ -"
    for _ in range(2000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        assert own(text).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, json.dumps(text)


def test_words_before_runs_of_marks_need_no_whole_encoding():
    own = tokens.Encoder(tokenizer_path())
    whole, text = own.tokenizer, "Word%%% wörd### word., word!? it''"
    own.tokenizer = None
    assert own(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "http://a/é", "same"), (2, None, "same"), (3, "u\r\nX: y", "same"), (4, "u", ""), (5, "u", None), (6, "u", "\U0001f600" * 400_000), (None, "u", "same"), (8, "u", "lone"), (8, "u", "lone")]
    pages += [(100 + i, f"http://h/{i}", f"<html>{i % 40} " + "text of a page " * 50) for i in range(400)]
    frame = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, bytes string")
    archives = warc.write_archives(frame)
    got = warc.read_archives(archives).collect()
    assert len(got) == len(pages)
    newest = {}
    for i, _, h in pages:
        newest[h or ""] = max(newest.get(h or "", -1), -1 if i is None else i)
    html = collections.defaultdict(set)
    for i, _, h in pages:
        html[i].add(h or "")
    for r in got:
        text = next(iter(html[r.page_id]))
        assert (r.payload_bytes, r.payload_digest) == (len(text.encode()), warc.digest_base32(text.encode()))
        if r.record_type == "response":
            assert r.page_id == newest[text] and r.payload.decode() == text and r.refers_to is None
        else:
            assert r.refers_to == newest[text]
    assert collections.Counter(r.record_type for r in got)["response"] == len(newest)
    assert len({r.record_id for r in got}) == len(got)
    folder = f"file://{tmp_path}/archives"
    assert warc.export_archives(archives, folder).agg(F.sum("bytes")).first()[0] == sum(p.stat().st_size for p in (tmp_path / "archives").glob("*.warc.zst"))
    assert sorted(map(str, warc.read_files(spark, folder).collect())) == sorted(map(str, got))


def test_bad_archives_are_told():
    record = warc.record_bytes("urn:page:1:0", "u", b"payload", "response", None)
    good = warc.archive_bytes([record], [b"payload"])
    assert [warc.parse_record(r)["payload"] for r in warc.read_archive(good)] == [b"payload"]
    assert list(warc.read_archive(good[8:])) == list(warc.read_archive(good[:8] + struct.pack("<II", 0x184D2A50, 3) + b"abc" + good[8:])) == [record]
    for bad in (good[:-3], b"", b"\0" * 20, good[:4] + b"\xff\0\0\0"):
        with pytest.raises((warc.BadArchive, warc.zstd.ZstdError)):
            list(warc.read_archive(bad))
    for broken in (record.replace(b"payload\r\n", b"payloae\r\n"), record[:-4], record.replace(b"WARC/1.1", b"WARC/0.9")):
        with pytest.raises(warc.BadArchive):
            warc.parse_record(broken)


def test_records_of_other_writers():
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\nhello"

    def record(kind, block, version=b"WARC/1.0", **more):
        names = {"warc-type": kind, "WARC-Record-ID": "<urn:uuid:1>", "Content-Length": str(len(block)), **{k.replace("_", "-"): v for k, v in more.items()}}
        return version + b"\r\n" + b"".join(f"{k}:{v}\r\n".encode() for k, v in names.items()) + b"\r\n" + block + b"\r\n\r\n"

    assert warc.parse_record(record("warcinfo", b"software: x"))["payload"] == b"software: x"
    own = warc.parse_record(record("response", http, content_type="application/http; msgtype=response", warc_payload_digest="sha1:" + warc.digest_base32(b"hello"), warc_target_uri="<http://a/>", x_folded="a\r\n b"))
    assert (own["payload"], own["payload_bytes"], own["target_uri"], own["page_id"], own["record_id"]) == (b"hello", 5, "http://a/", None, "urn:uuid:1")
    assert warc.parse_record(record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", content_type="application/http"))["payload_bytes"] == 0
    assert warc.parse_record(record("revisit", b"", warc_payload_digest="sha1:" + "A" * 32))["payload_digest"] == "A" * 32
    assert warc.parse_record(record("metadata", b"", b"WARC/1.1"))["payload_bytes"] == 0
    for bad in (record("response", http, content_type="application/http", warc_payload_digest="sha1:" + "A" * 32), record("resource", b"x", warc_block_digest="sha1:" + "A" * 32), record("resource", b"x").replace(b"warc-type", b"x"), record("resource", b"x", b"WARC/2.0")):
        with pytest.raises(warc.BadArchive):
            warc.parse_record(bad)


def test_frequent_and_full_lengths_are_packed_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", (8, 16))
    rows = [(i, "some words here", "s") for i in range(700)] + [(1000 + i, "word " * r, "s") for i, r in enumerate(random.Random(3).choices(range(5, 9000), k=60))] + [(2000 + i, "word " * 4095, "s") for i in range(5)]
    got = packing.pack(docs(spark, rows)).collect()
    sequences = collections.defaultdict(list)
    for x in got:
        sequences[x.sequence_id].append((x.offset, x.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len({(x.doc_id, x.piece) for x in got}) == len(got) and {x.doc_id for x in got} == {i for i, _, _ in rows}
    assert len(sequences) <= sum(x.length for x in got) / 4096 * 1.05 + 2


def test_shuffle_files_of_a_settled_table_go(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, held = spark.conf.get(key, None), blocks.getAllFiles().size()
    made = settle(spark.range(100_000).groupBy((F.col("id") % 5_003).alias("k")).count(), "counts")
    deadline = time.time() + 20
    while blocks.getAllFiles().size() > held and time.time() < deadline:
        time.sleep(0.2)
    assert blocks.getAllFiles().size() <= held
    assert spark.conf.get(key, None) == before
    assert made.count() == 5_003
