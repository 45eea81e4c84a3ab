"""Similarity joins, repeats and contamination against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

from taproot.llm import common, components, decontaminate, ngram_join, substring_dedup
from tests.llm.conftest import prose


def test_repeats(docs, rows, none):
    words = [(t or "").encode().split() for _, t in rows]
    starts = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = Counter()
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {k for i in range(len(w) - 34) if starts[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    got = substring_dedup.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == want
    assert all(sum(s["last"] - s["first"] for s in r.spans) == r.n_removed for r in got)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_many_buckets_give_the_same(docs, monkeypatch):
    want = Counter(tuple(r) for r in substring_dedup.remove_repeats(docs).drop("spans").collect())
    monkeypatch.setattr(substring_dedup, "BUCKET", 10)
    assert Counter(tuple(r) for r in substring_dedup.remove_repeats(docs).drop("spans").collect()) == want


def test_every_residue_is_a_difference():
    p, c = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % p for a in c for b in c} == set(range(p))


def brute_links(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().split()
        sets.append((i, t or "", {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}))
    links = defaultdict(set)
    for a, (i, t, s) in enumerate(sets):
        for b, (j, u, v) in enumerate(sets):
            if a != b and (t == u or (s and v and 5 * len(s & v) >= 4 * len(s | v))):
                links[a].add(b)
    return links


def test_join_equals_brute_force(spark, docs, rows, none):
    known = [r for r in rows if r[0] is not None]
    links = brute_links(known)
    got = {(r.doc_id, r.n_links) for r in ngram_join.ngram_join(docs).collect() if r.doc_id is not None}
    assert got == {(known[a][0], len(links[a])) for a in range(len(known))}
    lost = [r for r in ngram_join.ngram_join(docs).collect() if r.doc_id is None]
    assert len(lost) == 2 and all(r.class_id is None and r.n_links == 0 for r in lost)
    assert ngram_join.ngram_join(none).count() == 0
    kept = ngram_join.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 4, 6, 7, 9, 10, 11, 12, 13, 14, 15, 16] and ids.count(None) == 2


def test_different_texts_under_one_id_are_different_nodes(spark):
    a, b = prose(60, 100), prose(61, 100)
    near = lambda t: " ".join([*t.split()[:99], "x"])
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (4, prose(62, 100))]
    got = sorted(tuple(r) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 1, 1), (1, 1, 1, 1), (2, 1, 2, 1), (3, 1, 3, 1), (4, 4, 4, 0)]
    more = [*rows, (4, near(a)), (1, a)]
    kept = ngram_join.deduplicated(spark.createDataFrame(more, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in kept) == sorted([(1, a), (1, b), (4, rows[4][1])])


def test_blocks_without_a_common_band_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    words = prose(63, 700).split()
    rows = [(i, " ".join(words[5 * i : 5 * i + 150])) for i in range(100)]  # a chain: only neighbours are alike
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = brute_links(rows)
    assert {r.doc_id: r.n_links for r in ngram_join.ngram_join(df).collect()} == {i: len(links[i]) for i in range(100)}


def test_a_large_group_of_near_copies_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    base = prose(50, 100).split()
    rows = [(i, " ".join([*base[:k], f"w{i}", *base[k + 1 :]])) for i in range(300) for k in [i % 97]]
    rows += [(1000 + i, prose(100 + i, 100)) for i in range(50)]
    links = brute_links(rows)
    got = {r.doc_id: r.n_links for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[a][0]: len(links[a]) for a in range(len(rows))}


def test_contamination(spark, docs, none):
    item, other = prose(900, 40), prose(901, 20)
    edited = item.split()
    edited[39] = "changed"
    half = " ".join(item.split()[:20])
    rows = [(1, prose(1, 50) + " " + item + " " + prose(2, 50)), (2, item.upper()), (3, prose(3, 20) + "\n" + " ".join(edited)), (4, half + " " + prose(4, 60)), (5, item + " " + other), (6, None), (7, ""), (8, prose(5, 3000)), (8, prose(5, 3000)), (None, other)]
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "too short"), (5, "")], "item_id long, text string")
    own = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _hit int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(own, bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (5, 1), (5, 2), (None, 2)}
    assert sorted(r.doc_id for r in decontaminate.decontaminated(own.drop("_hit"), bench).collect()) == [4, 6, 7, 8, 8]
    assert decontaminate.matches(none, bench).count() == 0
    assert decontaminate.matches(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_components_broadcast_few_labels_and_shuffle_many(spark, monkeypatch):
    rnd = random.Random(6)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)] + [(None, 5), (7, 7)]
    least = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in least:
        for a, b in edges:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame(edges, "a long, b long")
    shuffles = []

    class Stored(components.Stored):
        def __init__(self, df):
            shuffles.append(df._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin"))
            super().__init__(df)

    monkeypatch.setattr(components, "Stored", Stored)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert dict(map(tuple, components.components(df).collect())) == least
        assert sum(shuffles) == 0
        monkeypatch.setattr(components, "FEW", 3)
        assert dict(map(tuple, components.components(df).collect())) == least
        assert sum(shuffles) > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_flipped_blocks_are_not_broadcast(spark):
    some = spark.range(4).selectExpr("id AS window", "id AS item_id", "id * 7919 AS fp")
    plan = decontaminate.near(some.select("window", "fp"), some.select("item_id", "fp"))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_blocks_find_all_within_the_radius(spark):
    import random

    rnd = random.Random(5)
    base = [rnd.getrandbits(64) - 2**63 for _ in range(20)]
    queries = []
    for b in base:
        for k in (0, 3, 9, 15):
            x = b & (2**64 - 1)
            for bit in rnd.sample(range(64), k):
                x ^= 1 << bit
            queries.append((len(queries), x - 2**64 if x >= 2**63 else x))
    q, i = spark.createDataFrame(queries, "window long, fp long"), spark.createDataFrame(list(enumerate(base)), "item_id long, fp long")
    got = {tuple(r) for r in decontaminate.near(q, i, 15).collect()}
    want = {(w, k) for w, x in queries for k, b in enumerate(base) if ((x ^ b) & (2**64 - 1)).bit_count() <= 15}
    assert got == want


def test_a_full_filter_loses_no_match(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BITS_MIN", 1 << 6)
    monkeypatch.setattr(decontaminate, "BITS_MAX", 1 << 6)
    items = [(i, prose(1200 + i, 30 + i)) for i in range(30)]
    rows = [(i, prose(1300 + i, 25) + " " + t + " " + prose(1400 + i, 25)) for i, t in items] + [(100, prose(1500, 200))]
    found = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.start, r.n_words, r.similarity) for r in found.collect()} == {(i, i, 25, 30 + i, 1.0) for i, _ in items}


def test_an_item_within_a_longer_one_is_found(spark):
    inner = prose(1600, 60)
    items = [(1, inner), (2, prose(1601, 25) + " " + inner + " " + prose(1602, 25))]
    found = decontaminate.matches(spark.createDataFrame([(1, prose(1603, 30) + " " + items[1][1])], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.item_id, r.start, r.n_words) for r in found.collect()} == {(1, 55, 60), (2, 30, 110)}


def test_an_item_without_its_shared_part_is_found(spark):
    shared = prose(1700, 60)
    own = [prose(1701 + i, 144) for i in range(20)]
    bench = spark.createDataFrame([(i, shared + " " + t) for i, t in enumerate(own)] + [(100 + i, t + " " + shared) for i, t in enumerate(prose(1750 + i, 144) for i in range(20))], "item_id long, text string")
    last = bench.where("item_id = 103").first().text.split()[:144]
    rows = [(1, prose(1800, 40) + " " + own[3] + " " + prose(1801, 40)), (2, prose(1802, 40) + " " + " ".join(last) + " " + prose(1803, 40)), (3, shared + " " + prose(1804, 144))]
    sets = {r.item_id: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for r in bench.collect() for w in [r.text.split()]}
    often = Counter(g for s in sets.values() for g in s)
    weight = lambda s: sum(1 + 1 / often[g] for g in s)
    words = own[3].split()
    assert weight({tuple(words[k : k + 5]) for k in range(140)}) / weight(sets[3]) >= 0.8
    got = {(r.doc_id, r.item_id, r.start, r.n_words) for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 3, 40, 144), (2, 103, 40, 144)}


def queries_of(spark, f):
    """What ``f`` gives, and how many queries Spark ran for it."""
    ids = lambda: spark.range(1)._jdf.sparkSession().sharedState().statusStore().executionsCount()
    before = ids()
    found = f()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return found, ids() - before


def test_stored_tables_are_counted_as_they_are_written(spark):
    for df, n in ((spark.range(1000).repartition(7), 1000), (spark.range(0), 0), (spark.range(10).where("id < 0").distinct(), 0), (spark.range(9).join(spark.range(3), "id").groupBy("id").count(), 3)):
        table, ran = queries_of(spark, lambda df=df: common.Counted(df))
        assert (table.rows, table.read().count()) == (n, n) and ran == 1


def test_a_round_of_components_runs_three_queries(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (4, 4)], "a long, b long")
    found, ran = queries_of(spark, lambda: components.components(edges))
    assert ran <= 4  # the edges, and a round that leaves none
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)}


def jobs_of(spark, f):
    """What ``f`` gives, and how many jobs Spark ran for it."""
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    found = f()
    return found, jobs() - before


def test_a_round_of_components_broadcasts_each_table_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (4, 4), *((i, i + 1) for i in range(20, 29))], "a long, b long")
    found, ran = jobs_of(spark, lambda: {tuple(r) for r in components.components(edges).collect()})
    assert found == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7), *((i, 20) for i in range(20, 30))}
    assert ran <= 21


def test_decontamination_runs_few_queries(spark):
    item = prose(1900, 40)
    bench = spark.createDataFrame([(1, item), (2, prose(1901, 30))], "item_id long, text string")
    docs = spark.createDataFrame([(1, prose(1902, 20) + " " + item), (2, prose(1903, 60))], "doc_id long, text string")
    found, ran = queries_of(spark, lambda: [r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()])
    assert found == [2] and ran <= 10  # nine tables or figures, and the result
