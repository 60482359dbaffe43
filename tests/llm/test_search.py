"""Searches, packing, classifiers and the pipeline against brute force or held-out labels."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmill.llm import fingerprints, language, near_dedup, packing, quality, queries, toxicity
from siltmill.llm.text import words

from . import edges

SF = "/root/testdata/sf0.001"


def _edit(text, seed, share):
    r = random.Random(seed)
    return " ".join("new%d" % r.randint(0, 10**6) if r.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def copies():
    """Groups of near copies of many sizes, and lone texts."""
    out, n = [], 0
    for g, size in enumerate([1] * 60 + [2] * 15 + [6] * 4 + [70, 150]):
        base = edges.prose(1000 + g, 120)
        for k in range(size):
            out.append((n, base if k == 0 else _edit(base, n, 0.02 + 0.08 * (k % 3) / 2)))
            n += 1
    return out


def test_forest_recall(spark, copies):
    sets = [set(s.tolist()) for s in near_dedup.shingles([t for _, t in copies])]
    rows = near_dedup.groups(spark.createDataFrame(copies, "doc_id long, text string")).collect()
    group = {r.doc_id: r.group_id for r in rows}
    true = found = wrong = 0
    for i in range(len(copies)):
        for j in range(i):
            near = len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= near_dedup.THRESHOLD
            true += near
            found += near and group[i] == group[j]
            wrong += group[i] == group[j] and len(sets[i] & sets[j]) == 0
    assert found >= 0.98 * true and wrong == 0
    assert all(r.keep == (r.doc_id == r.group_id) for r in rows)
    assert all(min(i for i in group if group[i] == g) == g for g in set(group.values()))


def test_forest_works_off_large_regions(spark, copies, monkeypatch):
    monkeypatch.setattr(near_dedup, "HELD", 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        rows = near_dedup.groups(spark.createDataFrame(copies, "doc_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len({r.group_id for r in rows}) <= 85


def _hot(n, words, shared, pairs=0, common=0):
    """Texts of which a passage of so many shingles is shared by all; of the first rows, two share more of them."""
    hot = edges.prose(77, shared + 2)
    out = []
    for k in range(n):
        own = edges.prose(10_000 + k, words - shared)
        if k < 2 * pairs and k % 2:
            own = " ".join(out[k - 1][1].split()[shared + 2 : shared + 2 + common] + own.split()[common:])
        out.append((k, hot + " " + own))
    return out


def test_forest_verifies_pairs(spark):
    """Half of each text is one passage: a Jaccard similarity of a third, and no pair is near."""
    texts = _hot(600, 100, 50)
    rows = near_dedup.groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(rows) == 600 and all(r.keep for r in rows)


def test_forest_recall_of_hot_passages(spark):
    """Half of each text is one passage; pairs of a Jaccard similarity of 0.43 stand in regions of hundreds of rows."""
    texts = _hot(1500, 100, 50, pairs=300, common=11)
    sets = [set(s.tolist()) for s in near_dedup.shingles([t for _, t in texts[:600]])]
    assert all(0.4 < len(a & b) / len(a | b) < 0.45 for a, b in zip(sets[::2], sets[1::2]))
    group = {r.doc_id: r.group_id for r in near_dedup.groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert np.mean([group[k] == group[k + 1] for k in range(0, 600, 2)]) >= 0.9
    assert len(set(group.values())) >= 1200


def test_forest_cuts_full_regions(spark):
    """With regions cut early, near pairs beside a passage that all share still meet, and none are made up."""
    texts = _hot(700, 100, 50, pairs=100, common=11)
    group = {r.doc_id: r.group_id for r in near_dedup.groups(spark.createDataFrame(texts, "doc_id long, text string"), full=40).collect()}
    assert np.mean([group[k] == group[k + 1] for k in range(0, 200, 2)]) >= 0.9
    assert len(set(group.values())) >= 600


@pytest.mark.parametrize("kind", ["rare", "common"])
def test_forest_loses_no_link_of_full_regions(spark, kind, monkeypatch):
    """Links that no prefix and hardly any rare min-hash finds: by one rare shingle, or by unlike parts of a passage."""
    monkeypatch.setattr(near_dedup, "TILE", 60)  # several tiles
    if kind == "rare":
        texts = _hot(300, 100, 57, pairs=100, common=1)
    else:
        r, hot, texts = random.Random(8), edges.prose(77, 140).split(), []
        for k in range(300):
            a = r.randint(0, 50)
            texts.append((k, " ".join(hot[a : a + r.choice([60, 75, 90])]) + " " + edges.prose(30_000 + k, r.randint(45, 110))))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    inside = {r.id for r in near_dedup.full_regions(near_dedup.signatures(docs, "doc_id", "text"), 40).select("id").collect()}
    group = {r.doc_id: r.group_id for r in near_dedup.groups(docs, full=40).collect()}
    want = _near_groups({i: t for i, t in texts if i in inside})
    assert len(inside) > 250 and 20 < len(set(want.values())) < len(inside) - 20
    firsts = {}
    for i, g in want.items():
        assert group[i] == firsts.setdefault(g, group[i])
    whole = _near_groups(dict(texts))
    assert all(whole[i] == whole[g] for i, g in group.items())


def test_class_links_by_brute_force(monkeypatch):
    """Components and reach of sets of common shingles, in one block and between two, by small strips."""
    monkeypatch.setattr(near_dedup, "STRIP", 7)
    monkeypatch.setattr(near_dedup, "HELD", 5)
    rng = np.random.RandomState(4)
    for case in range(40):
        sets = [np.unique(rng.randint(0, 30, rng.randint(5, 25)) + 30 * rng.randint(0, 2)) for _ in range(30)]
        size = np.array([len(s) + rng.randint(0, len(s) + 1) for s in sets])
        root = rng.randint(0, 30, 30)
        later = rng.random(30) < 0.5 if case % 2 else None
        both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
        met = ~np.eye(30, dtype=bool) if later is None else later[:, None] != later
        near = met & (both / (size[:, None] + size - both) >= 0.4)
        got, limit, by, shared = near_dedup.class_links(sets, size, root, later, 0.4)
        assert all(near[i, j] for i, j in got)

        def joined(pairs):
            at = root.copy()
            for i, j in pairs:
                at[at == at[j]] = at[i]
            return {tuple(np.flatnonzero(at == x)) for x in at}

        assert joined(got) == joined(np.argwhere(near)) and len(got) == len(set(root)) - len(joined(got))
        reach = np.where(met & (both > 0), 3.5 * both - size, -np.inf)
        for i in range(30):
            assert max(limit[i], 0) == pytest.approx(max(reach[i].max(), 0))
            assert limit[i] <= 0 or (reach[i, by[i]] == pytest.approx(limit[i]) and shared[i] == both[i, by[i]])


@pytest.mark.parametrize("noise", [0.0, 0.02])
def test_forest_joins_what_a_passage_makes_near(spark, noise):
    """The passage is most of each text, so all are near, whatever the regions hold; some copies of it differ."""
    hot = edges.prose(77, 120)
    texts = [(k, (_edit(hot, k, noise) if noise else hot) + " " + edges.prose(20_000 + k, 20 + k % 30)) for k in range(400)]
    for full in (40, 10_000):
        rows = near_dedup.groups(spark.createDataFrame(texts, "doc_id long, text string"), full=full).collect()
        assert len(rows) == 400 and sum(r.group_id == 0 for r in rows) >= (400 if not noise or full > 400 else 392)


def test_forest_bounds_regions(spark):
    """Of one passage in all texts no region is larger than it may be, but for whole labels cut by chance."""
    texts = _hot(600, 100, 95)
    docs = spark.createDataFrame(texts, "id long, text string")
    signed = near_dedup.signatures(docs, "id", "text")
    deeper = near_dedup.full_regions(signed, 50)
    rows, pairs, _ = near_dedup.rare_rows(docs, deeper.select("id"), 50)
    most = [d.groupBy("region").count().agg(F.max("count")).first()[0] for d in (near_dedup.tree_rows(deeper), rows)]
    assert deeper.count() == 600 and most[0] <= 90 and most[1] <= 50
    assert near_dedup.tree_rows(deeper).count() == 600 * near_dedup.TREES and pairs.count() == 599
    assert near_dedup.full_regions(signed, 600) is None


def test_regions_compare_all_pairs():
    r = np.random.RandomState(5)
    kinds = r.randint(0, 256, (12, near_dedup.SKETCH // 2)).astype(np.uint8)
    sketches = kinds[r.randint(0, 12, 300)]
    changed = r.random(sketches.shape) < r.choice([0.1, 0.45, 0.6], 300)[:, None]
    sketches = np.where(changed, r.randint(0, 256, sketches.shape).astype(np.uint8), sketches)
    labels = np.sort(r.randint(0, 40, 300))[:, None].repeat(near_dedup.DEPTH, 1).astype(np.uint32)
    share = np.array([near_dedup._shares(sketches.view(np.uint64), s) for s in sketches.view(np.uint64)])

    def joined(pairs):
        at = list(range(300))
        for i, j in pairs:
            at = [at[i] if x == at[j] else x for x in at]
        return [[i for i in range(300) if at[i] == x] for x in sorted(set(at))]

    for threshold, sure in ((0.3, 0.6), (0.3, 2.0), (0.5, 0.6)):
        found = near_dedup._Region(labels, sketches, threshold, sure)
        list(found.whole(0, 300))
        got = {(min(p), max(p)) for p in zip(*(x.tolist() for x in found.taken()))}
        want = {(i, j) for i in range(300) for j in range(i + 1, 300) if share[i, j] >= threshold}
        assert got <= want and (sure < 1 or got == want)
        # a pair that isn't given is of rows that sure pairs join
        near = {i: k for k, g in enumerate(joined([p for p in got if share[p] >= sure])) for i in g}
        assert all(near[i] == near[j] for i, j in want - got)


def test_region_in_many_batches(spark, monkeypatch):
    """One label, and rows of two kinds in turn: no row of the second kind is near the first row."""
    kinds = [bytes(near_dedup.SKETCH // 2), bytes([0x5A] * (near_dedup.SKETCH // 2))]
    signed = spark.createDataFrame([(k, bytes(4 * near_dedup.TREES * near_dedup.DEPTH), kinds[k % 2]) for k in range(200)], "id long, label binary, sketch binary")
    monkeypatch.setattr(near_dedup, "HELD", 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        rows = near_dedup.connected_components(near_dedup.tree_edges(signed)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.id: r.component for r in rows} == {k: k % 2 for k in range(200)}


def test_overlaps_are_exact(monkeypatch):
    monkeypatch.setattr(near_dedup, "LOOKED_UP", 50)
    r = np.random.RandomState(3)
    sets = [np.unique(r.randint(0, 60, r.randint(1, 40)).astype(np.uint32)) for _ in range(30)]
    left, right = r.randint(0, 30, 500), r.randint(0, 30, 500)
    want = [len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for i, j in zip(left, right)]
    assert near_dedup.overlaps(sets, left, right).tolist() == want


def test_forest_rows(spark):
    rows = {r.doc_id: r for r in near_dedup.groups(edges.table(spark)).collect()}
    assert None not in rows and rows[6].group_id == rows[12].group_id == rows[5].group_id == 5
    assert all(rows[i].keep for i in (1, 2, 3, 4, 5, 7)) and not rows[6].keep
    kept = [r.doc_id for r in near_dedup.keep_one(edges.table(spark)).collect()]
    same = spark.createDataFrame([(1, "one text"), (1, "another text of it"), (1, "one text")], "doc_id long, text string")
    assert sorted(r.text for r in near_dedup.keep_one(same).collect()) == ["another text of it", "one text"]
    assert kept.count(5) == 1 and 6 not in kept and kept.count(None) == 2


def _hamming(a, b):
    return (((a ^ b) + (1 << 64)) % (1 << 64)).bit_count()


def test_simhash_search_is_exact(spark):
    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(60)]
    prints = set()
    for b in base:
        for _ in range(6):
            x = b
            for k in r.sample(range(64), r.randint(0, 5)):
                x ^= 1 << k
            prints.add(x - (1 << 64) * (x >> 63))
    prints = sorted(prints)
    for radius, blocks in ((3, 6), (3, 4), (1, 3), (0, 1), (5, 8)):
        got = fingerprints.near_fingerprints(spark.createDataFrame([(p,) for p in prints], "fingerprint long"), radius, blocks)
        want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if _hamming(a, b) <= radius}
        rows = [(x.left, x.right) for x in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_simhash_rows(spark):
    rows = fingerprints.near_documents(edges.table(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].fingerprint is None and by[1][0].near_id is None
    assert {(r.near_id, r.distance) for r in by[6]} >= {(5, 0)} and {r.near_id for r in by[12]} >= {5}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF).toPandas()
    cols = sorted(got.columns)
    want = con.sql(queries.oracle_sql()[name]).df()[cols]
    a, b = (sorted(x[cols].astype(str).itertuples(index=False, name=None)) for x in (got, want))
    assert a == b


def _least_bins(sizes, capacity):
    """The optimum, by search."""
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms)}.values():
            if rooms[k] >= sizes[i]:
                go(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    r = random.Random(8)
    for _ in range(200):
        capacity = r.choice([10, 20, 37])
        sizes = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 10))), reverse=True)
        counts = {s: sizes.count(s) for s in set(sizes)}
        fixed, rest = packing.reduce_instance(counts, capacity)
        assert all(sum(f) <= capacity for f, _ in fixed)
        left = sorted((s for s, n in rest.items() for _ in range(n)), reverse=True)
        assert sorted([s for f, n in fixed for s in f * n] + left) == sorted(sizes)
        assert sum(n for _, n in fixed) + _least_bins(left, capacity) == _least_bins(sizes, capacity)


def test_plan_is_bounded_by_the_capacity():
    for small in ({1100: 1, 450: 2}, {900: 2, 248: 1}, {1500: 3, 700: 5, 300: 4, 200: 9}, {k: 1 + k % 3 for k in range(1, 2049, 7)}):
        told = [packing.plan_bins({k: v * n for k, v in small.items()}, 2048) for n in (1000, 32_000)]
        assert len(told[1][0]) <= len(told[0][0]) + 20 and len(told[1][0]) <= 4 * 2048
        assert abs(told[1][1]["bins"] - 32 * told[0][1]["bins"]) <= 32 * len(small)
    assert packing.plan_bins({1100: 32_000, 450: 64_000}, 2048)[1] == {"bins": 32_000, "fixed_bins": 32_000, "fixed_sets": 1}


def test_reduction_of_many_copies():
    """Fixing a set many times at once is fixing it one at a time."""
    r = random.Random(18)
    for _ in range(150):
        capacity = r.choice([12, 20])
        counts = {r.randint(2, capacity): r.randint(1, 4) for _ in range(r.randint(1, 3))}
        sizes = sorted((s for s, n in counts.items() for _ in range(n)), reverse=True)
        fixed, rest = packing.reduce_instance(counts, capacity)
        left = sorted((s for s, n in rest.items() for _ in range(n)), reverse=True)
        assert sorted([s for f, n in fixed for s in f * n] + left) == sorted(sizes)
        assert sum(n for _, n in fixed) + _least_bins(left, capacity) == _least_bins(sizes, capacity)


def test_plan_holds_every_piece():
    r = random.Random(9)
    for _ in range(100):
        capacity = r.choice([5, 30, 100])
        counts = {}
        for _ in range(r.randint(0, 50)):
            k = r.randint(1, capacity)
            counts[k] = counts.get(k, 0) + r.randint(1, 4)
        ranges, told = packing.plan_bins(counts, capacity)
        bins = {}
        for length, _, n, first, offset in ranges:
            for i in range(n):
                bins.setdefault(first + i, []).append((offset, length))
        assert sum(n for _, _, n, _, _ in ranges) == sum(counts.values()) and set(bins) == set(range(told["bins"]))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= capacity


def test_pack_rows(spark):
    capacity, texts = 50, edges.TEXTS
    rows = packing.pack(edges.table(spark), capacity).collect()
    words = lambda t: len(__import__("re").findall(r"[^ \t\n\x0b\f\r]+", t or ""))
    got = sorted((str(r[2]), r.piece_start, r.length) for r in rows)
    want = sorted((str(i), a, min(capacity, words(t) - a)) for i, t in texts for a in range(0, words(t), capacity))
    assert got == want
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append((r.start, r.length))
    for b in bins.values():
        assert all(x[0] + x[1] <= y[0] for x, y in zip(sorted(b), sorted(b)[1:])) and max(x + y for x, y in b) <= capacity
    few = packing.pack(edges.table(spark), capacity, ranked=3).collect()  # many buckets of a length
    assert sorted((r.bin_id, r.start, r.length) for r in few) == sorted((r.bin_id, r.start, r.length) for r in rows)
    assert sorted((str(r[2]), r.piece_start, r.length) for r in few) == want
    again = packing.pack(edges.table(spark), capacity).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_unspaced_texts_are_cut(spark, tmp_path):
    import corpus_pipeline

    texts = [(0, "語" * 5000), (1, "ไทย" * 1000), (2, "one two\x1cthree\u3000four 五六\xa0\U00020001 é"), (3, "plain words\x1fonly"), (4, None), (5, " \u3000"), *((i + 6, t) for i, (_, t) in enumerate(edges.TEXTS))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for rows in (queries.op1_best_fit_packing(spark, str(tmp_path)).collect(), corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()):
        got = {}
        for r in rows:
            got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert max(r.length for r in rows) == 2048 and sum(r.doc_id == 0 for r in rows) == 3
        assert got == {i: n for i, t in texts if (n := len(words(t or "")))}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fit, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = language.fit_text_model(fit, "text", "lang", "doc_id")
    rows = language.identify(test, model=model).join(test.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.language == r.lang for r in rows]) > 0.98 and np.mean([r.keep for r in rows]) > 0.97


def test_evidence_decides_where_text_is_silent(spark):
    texts = {"en": "the quick thing of the other", "fr": "le chat de la maison des autres"}
    rows, n = [], 0
    for lang, t in texts.items():
        for k in range(40):
            rows.append((n, t + " " + edges.prose(n, 3), lang, f"http://h{k % 4}.{lang}site.{lang}/x"))
            n += 1
    rows += [(100, "123 456", None, "http://new.frsite.fr/"), (101, None, "en", None), (102, "", "fr", "http://other.fr/"), (103, "zqxj 一丁", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, url string")
    got = {r.doc_id: r for r in language.identify(docs, declared=F.col("lang"), host=language.host_of(F.col("url"))).collect()}
    assert got[100].language == "fr" and got[101].language == "en" and got[102].language == "fr"
    assert len(got) == len(rows) and all(0 < r.posterior <= 1 for r in got.values())


def _fused(model, texts, declared, hosts):
    """(language, posterior) of each row, by plain loops."""
    n, k = len(model.languages), language.PSEUDO
    ll = model.log_likelihood(texts) * language.TEMPER
    ll -= ll.max(1, keepdims=True)
    soft = np.exp(ll) / np.exp(ll).sum(1, keepdims=True)
    soft[ll.min(1) == 0] = 0
    declared = [d.lower() if d is not None else None for d in declared]

    def places(host):
        parts = host.split(".")
        return (parts[-1] or None if len(parts) > 1 else None), (".".join(parts[-2:]) if len(parts) > 1 else host)

    where = [(None, None, None) if h is None else (*places(h), h) for h in hosts]

    def smoothed(rows, up):
        total = sum((soft[i] for i in rows), np.zeros(n))
        return (total + k * up) / (total.sum() + k)

    everything = range(len(texts))
    overall = smoothed(everything, np.full(n, 1 / n))
    told = sum((soft[i] for i in everything if declared[i] is not None), np.zeros(n))
    out, done = [], {}
    for i in everything:
        key = (where[i], declared[i])
        if key not in done:
            suffix, domain, host = where[i]
            prior, d = overall, np.zeros(n)
            if host is not None:
                prior = smoothed([j for j in everything if where[j][0] == suffix], overall)
                prior = smoothed([j for j in everything if where[j][:2] == (suffix, domain)], prior)
                prior = smoothed([j for j in everything if where[j] == where[i]], prior)
            if declared[i] is not None:
                said = sum((soft[j] for j in everything if declared[j] == declared[i]), np.zeros(n))
                if said.sum() > 0:
                    d = np.log((said + said.sum() / told.sum()) / (told + 1))
            done[key] = np.log(prior) + d
        score = ll[i] + done[key]
        p = np.exp(score - score.max())
        out.append((model.languages[int(p.argmax())], 1 / p.sum()))
    return out


def test_language_by_loops(spark):
    """Documents, where source is a host without domain or suffix."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit_text_model(docs, "text", "lang", "doc_id")
    pdf = docs.toPandas()
    want = dict(zip(pdf.doc_id.tolist(), _fused(model, pdf.text.tolist(), pdf.lang.tolist(), pdf.source.tolist())))
    for r in queries.langid_documents(spark, SF).collect():
        assert r.language == want[r.doc_id][0] and abs(r.posterior - want[r.doc_id][1]) < 1e-6


def test_language_of_pages_by_loops(spark):
    """The registered query over whole pages, with several suffixes, domains and hosts, and some without any."""
    model = language.fit_text_model(spark.read.parquet(f"{SF}/documents.parquet"), "text", "lang", "doc_id")
    pages = queries.page_evidence(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert len({p.host.split(".")[-1] for p in pages if p.host}) > 1 and len({p.told for p in pages}) > 1
    want = dict(zip([p.page_id for p in pages], _fused(model, [p.body for p in pages], [p.told for p in pages], [p.host for p in pages])))
    rows = queries.op4_language_id(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.language == want[r.page_id][0] and abs(r.posterior - want[r.page_id][1]) < 1e-6
        assert r.keep == (r.language != language.NONE and r.posterior >= language.LEAST_POSTERIOR)


def test_language_levels_by_loops(spark):
    r = random.Random(21)
    words_ = {"en": "the of and thing that with".split(), "fr": "le la des une que dans".split(), "xx": "zub zob zab".split()}
    rows = []
    for k in range(150):
        lang = r.choice(["en", "fr"]) if k else "xx"  # one row of a language makes it one
        host = r.choice([None, "plain", "a.site.com", "b.site.com", "site.fr", "w.x.fr", "odd."])
        text = r.choice([None, "", "12 34"]) if k % 15 == 1 else " ".join(r.choice(words_[lang]) for _ in range(r.randint(1, 12)))
        rows.append((k, text, lang, r.choice([None, "EN", "fr", "de"]), host))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, told string, host string")
    model = language.fit_text_model(docs, "text", "label", "doc_id")
    assert model.languages == ["en", "fr", "xx", language.NONE]
    want = _fused(model, *[[x[i] for x in rows] for i in (1, 3, 4)])
    got = {x.doc_id: x for x in language.identify(docs, declared=F.col("told"), host=F.col("host"), model=model).collect()}
    for k, (name, p) in enumerate(want):
        assert abs(got[k].posterior - p) < 1e-6 and (got[k].language == name or p < 0.5 + 1e-6)
    kept = language.keep_known(docs, declared=F.col("told"), host=F.col("host"), model=model).collect()
    assert sorted(x.doc_id for x in kept) == sorted(k for k, x in got.items() if x.keep)


def test_language_ties_and_rows(spark):
    """Equal evidence goes to the first name; every row is judged by itself, whatever its id."""
    model = language.TextModel(["aa", "bb", language.NONE], np.zeros((1 << language.HASH_BITS, 3), np.float32))
    docs = spark.createDataFrame([(None, "x"), (1, ""), (1, None)], "doc_id long, text string")
    assert [r.language for r in language.identify(docs, model=model).collect()] == ["aa"] * 3
    texts = {"en": "the quick thing of the other", "fr": "le chat de la maison des autres"}
    rows = [(None if k % 2 else 7, texts[x] + " " + edges.prose(k, 3), x) for k in range(60) for x in texts] + [(7, "9 9", None), (None, "8 8", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = language.TextModel.fit([(t, x) for x, t in texts.items()] * 20)
    kept = language.keep_known(docs, model=fitted).collect()
    assert len(kept) >= 118 and sum(r.doc_id is None for r in kept) >= 59


def test_toxicity_held_out():
    r = random.Random(10)
    bad = ["scum", "moron", "wretch", "filth"]
    texts, toxic = [], []
    for k in range(900):
        w = edges.prose(5000 + k, 40).split()
        if k % 3 == 0:
            w[r.randint(0, 39)] = r.choice(bad)
        texts.append(" ".join(w))
        toxic.append(int(k % 3 == 0))
    model = toxicity.Classifier().fit(texts[:600], toxic[:600])
    score = model.scores(*toxicity.hashed(texts))
    step = np.floor(np.log(score / (1 - score)) * toxicity.STEPS).astype(int)
    limit = toxicity.thresholds([("xx" if k % 2 else None, int(step[k]), toxic[k], k < 600, 1) for k in range(750)])
    said = score[750:] >= limit[None]
    assert np.mean(said == np.array(toxic[750:], bool)) > 0.97 and set(limit) == {None, "xx"}


def test_thresholds_by_brute_force():
    """The best F1 of all cuts, classes at their natural ratio, and languages drawn to all by degrees."""
    r = random.Random(11)
    for _ in range(60):
        rows = [(r.choice(["a", "b", None]), r.randint(-5, 5), r.randint(0, 1), r.random() < 0.3, r.randint(1, 5)) for _ in range(r.randint(0, 40))]
        limit = toxicity.thresholds(rows)
        whole = [sum(n for _, _, y, _, n in rows if y == k) for k in (0, 1)]
        free = [sum(n for _, _, y, f, n in rows if y == k and not f) for k in (0, 1)]
        if not min(free):
            assert limit == {None: 0.5}
            continue

        def f1(cut, language):
            hits = found = real = 0.0
            for x, b, y, f, n in rows:
                w = 0 if f else n * whole[y] / free[y]
                w = w * (toxicity.PSEUDO / whole[1] + (x == language)) if language else w
                score = 1 / (1 + np.exp(-b / toxicity.STEPS))
                hits, found, real = hits + w * y * (score >= cut), found + w * (score >= cut), real + w * y
            return 2 * hits / (found + real)

        for language, cut in limit.items():
            cuts = [1 / (1 + np.exp(-b / toxicity.STEPS)) - 1e-9 for b in range(-5, 7)]
            assert abs(f1(cut, language) - max(f1(c, language) for c in cuts)) < 1e-9
    assert toxicity.thresholds([("a", 3, 1, False, 4), ("a", 3, 0, False, 4)])[None] == 1 / (1 + np.exp(-3 / toxicity.STEPS))


def test_toxicity_detects(spark):
    """The query's form is training and classifying; columns may have any names; all labelled rows count."""
    texts = [(k, edges.prose(6000 + k, 30) + (" scum wretch " if k % 4 == 0 else " ") + edges.prose(k, 5), "en" if k % 3 else "fr", k) for k in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, i int").selectExpr("*", "1 as y", "2 as t", "3 as d", "4 as f", "5 as b", "6 as words")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (9999, 1), (3, None)], "doc_id long, toxic int").selectExpr("*", "1 as y", "2 as i")
    rows = {r.doc_id: r.toxic for r in toxicity.detect(docs, labels).collect()}
    assert np.mean([rows[k] == (k % 4 == 0) for k in range(400)]) > 0.98 and len(rows) == 400
    model = toxicity.train(docs, labels)
    assert {r.doc_id: r.toxic for r in toxicity.classify(docs, model).collect()} == rows
    small, ids = toxicity.fit(docs, labels, rows=100, size=5000)
    assert 2 <= ids.count() <= 60


def test_toxicity_scores_by_loops():
    model = toxicity.Classifier(5)
    texts = ["one two three four", "", "x", "a b"] + [edges.prose(k, 50) for k in range(30)]
    codes, counts, rows = toxicity.hashed(texts)
    got = model.scores(codes, counts, rows)
    at = 0
    for g, n in zip(got, counts):
        words = model._words(rows[codes[at : at + n]])
        at += n
        if not n:
            assert g == 0
            continue
        padded = np.concatenate([words, np.zeros((2, words.shape[1]), np.float32)])
        top = [max(sum(float(padded[p + j] @ f[j][:, c]) for j in range(len(f)) if p + j < len(padded)) for p in range(n)) for f in model.filters for c in range(toxicity.FILTERS)]
        z = float(np.maximum(top, 0) @ model.out + model.bias)
        # windows that begin in the blanks after a text add nothing above zero
        assert abs(g - 1 / (1 + np.exp(-z))) < 1e-4


def test_toxicity_without_labels(spark):
    docs = edges.table(spark)
    labels = spark.createDataFrame([(4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    assert not any(r.toxic for r in toxicity.classify(docs, toxicity.train(docs, labels)).collect())


def _repeats(text, least):
    """(covered, longest) by sets of word runs."""
    t = quality._tokens(text)
    size, n = [len(w) for w in t], len(t)

    def again(m):
        """Where runs of m words begin that occur twice."""
        seen = {}
        for i in range(n - m + 1):
            seen.setdefault(tuple(t[i : i + m]), []).append(i)
        return [i for places in seen.values() if len(places) > 1 for i in places]

    marks = {j for i in again(least) for j in range(i, i + least)}
    longest, m = 0, least
    while starts := again(m):
        longest = max(longest, *(sum(size[i : i + m]) for i in starts))
        m += 1
    return (sum(size[j] for j in marks) / sum(size), longest / sum(size)) if t else (0.0, 0.0)


def _near_groups(texts):
    """The least id of each text's group, by all pairs' exact similarity."""
    sets = {}
    for i, text in texts.items():
        w = words(text.lower())
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= near_dedup.THRESHOLD * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_pipeline_by_brute_force(spark, tmp_path):
    """Every stage and the whole run over the whole table, against loops; with some texts of no language."""
    import corpus_pipeline

    r = random.Random(31)
    strange = [(90_000 + k, " ".join("".join(chr(r.randint(0x1200, 0x1340)) for _ in range(6)) for _ in range(40)), None, None, 280) for k in range(4)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.unionAll(spark.createDataFrame(strange, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    held = {r.doc_id: r for r in docs.collect()}
    model = language.fit_text_model(docs, "text", "lang", "doc_id")
    ids = sorted(held)
    said = _fused(model, [held[i].text for i in ids], [held[i].lang for i in ids], [held[i].source for i in ids])
    want = [{i for i, (name, p) in zip(ids, said) if name != language.NONE and p >= language.LEAST_POSTERIOR}]
    rated = {i: _repeats(held[i].text, quality.MIN_WORDS) for i in want[0]}
    want.append({i for i, (covered, longest) in rated.items() if covered <= quality.MAX_COVERED and longest <= quality.MAX_LONGEST})
    want.append({i for i, g in _near_groups({i: held[i].text for i in want[1]}).items() if i == g})
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], want):
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert sorted(r.doc_id for r in rows) == sorted(ids), name
        assert all(r == held[r.doc_id] for r in rows), name
        docs = spark.createDataFrame(rows, docs.schema)
    assert len(held) > len(want[0]) > len(want[1]) > len(want[2]) > 0
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {i for i in want[2] if held[i].text.split()}
    length = {i: len(words(held[i].text)) for i in want[2]}
    assert sorted((r.doc_id, r.piece_start, r.length) for r in rows) == sorted((i, a, min(2048, n - a)) for i, n in length.items() for a in range(0, n, 2048))
    rooms: list = []
    for n in sorted((r.length for r in rows), reverse=True):  # best fit decreasing, one by one
        fits = [k for k, room in enumerate(rooms) if room >= n]
        best = min(fits, key=rooms.__getitem__, default=None)
        if best is None:
            rooms.append(2048 - n)
        else:
            rooms[best] -= n
    bins = {}
    for r in rows:
        bins[r.bin_id] = bins.get(r.bin_id, 0) + r.length
    assert max(bins.values()) <= 2048 and len(bins) <= len(rooms)


def test_pipeline_edges(spark):
    import corpus_pipeline

    for docs in (edges.table(spark), edges.empty(spark), edges.table(spark, [(None, None)])):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).collect()
