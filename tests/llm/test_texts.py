"""Fingerprints, token files, packing and sharding against plain Python."""

import hashlib
import random
import struct
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taproot.llm import common, encoding, fingerprints, packing, sharding, token_files
from tests.llm.conftest import prose

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def coded(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_fingerprints(docs, rows, none):
    got = fingerprints.edited(docs).collect()
    assert len(got) == len(rows)
    assert Counter(r.n_chars for r in got) == Counter(len(t or "") for _, t in rows)
    by_text = defaultdict(set)
    lengths = defaultdict(list)
    for i, t in rows:
        lengths[i].append(t or "")
    for r in got:
        if len(lengths[r.doc_id]) == 1:
            by_text[lengths[r.doc_id][0]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values()) and len({x for v in by_text.values() for x in v}) == len(by_text)
    order = sorted([(i, t or "") for i, t in rows if i is not None and i != 16], reverse=True)
    found = {r.doc_id: r for r in got}
    for (i, t), (j, u) in zip(order, order[1:], strict=False):
        if (i, j) in ((17, 15),) or i == 17:
            continue
        k = len(t) // 3
        assert found[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest(), i
    assert found[2].near_next == 1.0 and 0.3 < found[12].near_edited < 0.8
    assert fingerprints.edited(none).count() == 0


def test_differing_branches(spark):
    cases = [
        ("a\nb\n\nc\nd", "a\nb\n\nc\nX", [(1, 1, "removed"), (1, 1, "added")]),
        ("same", "same", []),
        ("", "new", [(0, 0, "removed"), (0, 0, "added")]),
        ("a\nb\n\nc\nd\n", "new\na\nb\n\nc\nd\n", [(0, 0, "added")]),
        ("a\nb\nc\nd\ne\n", "a\nc\nd\nx\ne\n", [(0, 1, "removed"), (0, 3, "added")]),
        ("a\n\nb\n\nc", "b\n\na\n\nc", [(0, 0, "removed"), (0, 1, "removed"), (1, 0, "added"), (1, 1, "added")]),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i long, a string, b string")
    got = df.select("i", fingerprints.tree(df.a).alias("x"), fingerprints.tree(df.b).alias("y")).select("i", fingerprints.differing("x", "y").alias("d")).orderBy("i").collect()
    for r, (_, _, want) in zip(got[:5], cases, strict=False):
        assert [tuple(x) for x in r.d] == want, r
    moved = Counter(x.change for x in got[5].d)
    assert moved["added"] == moved["removed"] > 0


def test_one_more_word_changes_few_codes(spark):
    words = [w for i in range(40) for w in prose(i, 10).split()]
    df = spark.createDataFrame([(" ".join(words), " ".join([*words[:7], "word", *words[7:]]))], "a string, b string")
    made = fingerprints.fingerprints(fingerprints.fingerprints(df, "a", "a_"), "b", "b_")
    r = made.select(fingerprints.likeness(F.col("a_root"), F.col("a_codes"), F.col("b_root"), F.col("b_codes")).alias("like"), F.size("a_codes").alias("n")).first()
    assert r.like > 0.95 and r.n > 60


def test_successors_equal_a_plain_sort(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RUNS", 3)
    rnd = random.Random(9)
    ids = [rnd.randrange(-(2**63), 2**63) for _ in range(150)] + [7] * 90 + [2**63 - 1, 2**63 - 1, -(2**63)] + list(range(100, 140))
    rows = [(i, prose(5000 + k, rnd.randrange(1, 30))) for k, i in enumerate(ids)] + [(None, prose(6000 + k, 9)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = Counter()
    for (i, t), (_, u) in zip(order, [*order[1:], order[0]], strict=True):
        k = len(t) // 3
        want[i, len(t), hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.edited(df).collect()) == want


def test_fingerprints_write_no_tables_of_their_own(docs, rows, monkeypatch):
    monkeypatch.setattr(common, "Stored", None)
    assert fingerprints.edited(docs).count() == len(rows)


def test_wavelet_matrix():
    rnd = np.random.default_rng(1)
    ids = rnd.integers(0, 300, 9001)
    w = token_files.WaveletMatrix.build(ids, 9)
    assert (w.all() == ids).all()
    for i in (0, 1, 4095, 4096, 4097, 9000):
        assert w.access(i) == ids[i]
    for v in (0, 7, 299):
        at = np.flatnonzero(ids == v)
        assert w.count(v) == len(at) and w.rank(v, 5000) == (at < 5000).sum()
        assert [w.select(v, k) for k in range(len(at))] == at.tolist() and w.select(v, len(at)) is None
    assert token_files.WaveletMatrix.build(np.zeros(0, int), 9).all().tolist() == []


def test_token_files(docs, rows, none):
    got = token_files.token_files(docs, WORD, 1).collect()
    want = Counter()
    for i, t in rows:
        ids = [*coded(WORD, t), 1]
        want[i, len(ids), crc(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert [x for x in ids if x is not None] == sorted(x for x in ids if x is not None)
    assert token_files.token_files(none, WORD, 1).count() == 0


def test_packing(docs, rows, none):
    got = packing.pack(docs, BYTE, 0).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and all(r.sequence_length == at for r in s)
    want = defaultdict(list)
    for i, t in rows:
        ids = [*coded(BYTE, t), 0]
        want[i] += [(a, len(ids[a : a + 1024]), crc(ids[a : a + 1024]), len(ids)) for a in range(0, len(ids), 1024)]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.pack(none, BYTE, 0).count() == 0


ODD = [
    *"the The Don't ÀÉ straße İstanbul ΣΑΣ été e\u0301 \u0301 3.14 a,b .\" ... !!! $5 <|endoftext|> <|startoftext|> <|endo 日本 Привет x\x00y \x1c 's _ word, word.*** ﬁ ǆ \u212a ª".split(" "),
    "",
]
SPACES = [" ", " ", " ", "\n", "\n", "  ", "\n\n", "\t", "\r\n", " \n", "\n ", "\xa0", "\u2003", "\x85", "", "\x1d"]


@pytest.mark.parametrize("path, kind", [(WORD, encoding.LoweredWords), (BYTE, encoding.SpacedWords)])
def test_encoding_equals_the_library(path, kind):
    rnd = random.Random(3)
    texts: list = [None, ""]
    for i in range(3000):
        spaces = SPACES if i % 2 else SPACES[:5]
        t = "".join(rnd.choice(ODD) + rnd.choice(spaces) for _ in range(rnd.randrange(0, 8)))
        texts.append(t if i % 3 else t.strip())
    plain = Tokenizer.from_file(path)
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 9] for t in texts]
    codes, sizes = kind(path, memo=50).encode(pa.array(texts), 9)
    at = np.cumsum(sizes) - sizes
    ids = np.frombuffer(codes, "<u4")
    assert [ids[a : a + n].tolist() for a, n in zip(at.tolist(), sizes.tolist(), strict=True)] == want
    assert kind(path).encode(pa.array([], pa.string()), 9)[1].tolist() == []


def test_encoding_takes_little_memory_beside_its_result():
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}" for i in range(400_000)]
    texts = pa.array([" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)])
    enc = encoding.SpacedWords(BYTE)
    enc.encode(texts.slice(0, 1), 0)
    tracemalloc.start()
    codes, _ = enc.encode(texts, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak - 2 * len(codes) < 50 * len(words)
    held = encoding.groups(pa.record_batch([texts] * 4, names=["a", "b", "c", "d"]), 0)  # a worker holds one slice and a memo
    assert max(pa.compute.sum(pa.compute.binary_length(g.column(0))).as_py() for g in held) <= 3_000_000 and enc.letters.most <= 200_000


def test_words_of_the_older_generation_cost_no_call():
    letters = [a + b + c for a in "abcdefghijkl" for b in "mnopqrstuvwx" for c in "abcdefghij"]
    first, second = pa.array([" ".join(["x", *letters])]), pa.array([" ".join(["x", *(w + "q" for w in letters)])])
    enc = encoding.LoweredWords(WORD, memo=2000)
    want = enc.encode(first, 1)
    enc.encode(second, 1)
    assert len(letters) == 1440 and len(enc.letters) <= 2000 and len(enc.letters.older) <= 2000
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    got = enc.encode(first, 1)
    sys.setprofile(None)
    assert calls["call"] < 500
    assert got[0] == want[0] and got[1].tolist() == want[1].tolist()


def test_workers_give_memory_back_after_each_batch(monkeypatch):
    released = []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: released.append(1)})())
    given = [pa.record_batch([[i]], names=["a"]) for i in range(3)]
    assert list(common.sparing(lambda batches: (b for b in batches))(iter(given))) == given
    assert len(released) == 4


def test_rows_of_the_driver_become_a_table(spark):
    assert [tuple(r) for r in common.local_table(spark, [(1, None), (2, 3)], a=pa.int64(), b=pa.int32()).collect()] == [(1, None), (2, 3)]
    empty = common.local_table(spark, [], a=pa.int64(), b=pa.int32())
    assert empty.count() == 0 and empty.dtypes == [("a", "bigint"), ("b", "int")]


def test_special_tokens_are_encoded_as_the_library_does(spark):
    texts = ["<|startoftext|>", "one <|endoftext|>two", "<|endoftext|>" * 300, "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.token_files(df, WORD, 1).collect()}
    assert got == {i: (len(ids), crc(ids)) for i, t in enumerate(texts) for ids in [[*coded(WORD, t), 1]]}
    whole = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack(df, BYTE, 0).collect()}
    assert whole == {i: (len(ids), crc(ids)) for i, t in enumerate(texts) for ids in [[*coded(BYTE, t), 0]]}


def test_lookups_in_stored_shards(docs, rows, none):
    shards = token_files.write_shards(docs, WORD, 1, shard_ids=500).read()
    own = [r for r in token_files.read_shards(shards).join(token_files.starts(shards), "part").collect()]
    assert len({(r.part, r.shard) for r in own}) > 5
    sequence = {}
    texts = Counter(rows)
    for r in own:
        t = next(t for (i, t) in texts if i == r.doc_id and crc([*coded(WORD, t), 1]) == r.ids_crc32)
        sequence |= {r.before + r.local + k: (r.doc_id, x) for k, x in enumerate([*coded(WORD, t), 1])}
    often = [x for x, _ in Counter(x for _, x in sequence.values()).most_common(3)]
    asked = [*often, 49407, 70_000]
    assert {tuple(r) for r in token_files.counts(shards, asked).collect()} == {(a, sum(x == a for _, x in sequence.values())) for a in asked}
    found = {(r.id, r.doc_id, r.position) for r in token_files.occurrences(shards, asked).collect()}
    assert found == {(x, d, p) for p, (d, x) in sequence.items() if x in often}
    places = [0, 7, 499, 500, 501, len(sequence) - 1, len(sequence), -1]
    assert {tuple(r) for r in token_files.tokens(shards, places).collect()} == {(p, sequence[p][1]) for p in places if p in sequence}
    empty = token_files.write_shards(none, WORD, 1).read()
    assert token_files.occurrences(empty, [5]).count() == 0 and token_files.counts(empty, [5]).first()["count"] == 0


def test_an_id_beyond_the_planes_is_an_error():
    with pytest.raises(ValueError, match="70000"):
        token_files.WaveletMatrix.build(np.array([1, 70_000]), 16)
    assert token_files.WaveletMatrix.build(np.array([1, 70_000]), 17).all().tolist() == [1, 70_000]


@pytest.mark.parametrize("capacity", [8, 16, 100])
def test_best_fit_takes_the_tightest_window(capacity):
    rnd = np.random.default_rng(capacity)
    lengths = rnd.integers(1, capacity + 1, 300).tolist()
    windows, offsets, filled = packing.best_fit_decreasing(lengths, capacity)
    rooms: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in rooms if r >= lengths[i]]
        if fits:
            rooms[rooms.index(min(fits))] -= lengths[i]
        else:
            rooms.append(capacity - lengths[i])
    assert len(filled) == len(rooms) and sum(filled) == sum(lengths) and max(filled) <= capacity


def test_sharding(docs, rows, none):
    got = sharding.shard(docs, 4).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == [0, 1, 2, 3] and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shard(none, 4).count() == 0


def test_a_group_larger_than_a_shard_is_split_and_others_stay_whole(spark):
    df = spark.createDataFrame([(i, "same") for i in range(40)] + [(100 + i, f"pair {i // 2}") for i in range(80)], "doc_id long, text string")
    got = sharding.shard(df, 8).collect()
    shards = defaultdict(set)
    for r in got:
        shards[r.hub].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 8
    assert Counter(Counter(r.shard for r in got).values()) == {15: 8}


def test_small_groups_beside_a_hot_third_stay_whole(spark):
    df = spark.createDataFrame([(i, "same") for i in range(6000)] + [(10_000 + i, f"group {i % 3000}") for i in range(12_000)], "doc_id long, text string")
    got = sharding.shard(df, 8).collect()
    shards = defaultdict(set)
    for r in got:
        shards[r.hub].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 7
    assert Counter(Counter(r.shard for r in got).values()) == {2250: 8}


def test_near_copies_meet_and_cut_links_fall(spark):
    rnd = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for g in range(120):
        base = rnd.choice(words, 80).tolist()
        rows += [(100 * g + i, " ".join([*base[: 40 + i], f"x{i}", *base[41 + i :]])) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sharding.shard(df, 8).collect()}
    assert Counter(Counter(r.shard for r in got.values()).values()) == {90: 8}
    whole = sum(len({got[100 * g + i].shard for i in range(6)}) == 1 for g in range(120))
    assert whole >= 90
    links = sharding.links_of(df.selectExpr("doc_id AS node", "text"))
    before = sharding.cut_links(links, df.selectExpr("doc_id AS node").withColumn("label", sharding.first_label(8)))
    after = sharding.cut_links(links, spark.createDataFrame([(i, r.shard) for i, r in got.items()], "node long, label int"))
    assert before[0] == after[0] > 1000 and after[1] < before[1] / 4
    alike = [(i, "one") for i in range(5)] + [(10 + i, "two") for i in range(3)]
    rows, hubs = spark.createDataFrame(alike, "i long, key string"), spark.createDataFrame([("one", 5), ("two", 3), ("three", 0)], "key string, n long")
    want = rows.join(hubs, "key").collect()
    common.BROADCAST_ROWS, held = 2, common.BROADCAST_ROWS
    try:
        assert sorted(common.joined_by_hub(rows, hubs, "key", "n", 8).collect()) == sorted(want)
    finally:
        common.BROADCAST_ROWS = held
