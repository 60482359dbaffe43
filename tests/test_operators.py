"""Pipelines, graphs, spans and reports against plain Python and SQL."""

import random
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltmill.config import load_config
from siltmill.functions import hashing
from siltmill.operators import exact, intervals, minhash, simhash, substring, within
from siltmill.operators.graph import connected_components
from siltmill.operators.unionfind import UnionFind
from siltmill.plans import evaluate, pipelines, queries, report
from siltmill.sources import io
from siltmill.streaming.exact import first_seen

SF = "/root/testdata/sf0.001"
SOME = ["token_count", "ngram_count", "digests", "sha1_u32", "normalize_text", "news_preprocess", "exact_dedup_flags", "minhash_bands", "minhash_keep", "minhash_verified_keep", "minhash_report", "simhash_pairs", "simhash_keep", "simhash_verified_clusters", "simhash_verified_clusters_rootless", "simhash_report", "simhash_verified_keep", "title_and_abstract", "ground_truth", "result_table", "repeated_windows", "repeated_spans", "span_restore_size", "cluster_treemap", "cluster_jaccard_stats", "interval_merge_longest", "interval_merge_overlapping", "span_restore_merged", "components", "eval_sets", "eval_summary", "adjusted_rand", "cluster_summary", "cluster_size_bins", "cluster_quartiles", "top_clusters", "cluster_compare", "text_search"]


@pytest.mark.parametrize("name", SOME)
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.queries()[name](spark, SF).toPandas()
    cols = sorted(got.columns)
    want = con.sql(queries.oracle_sql()[name]).df()[cols]
    a, b = (sorted(x[cols].astype(str).itertuples(index=False, name=None)) for x in (got, want))
    assert a == b


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 120), r.randint(0, 120)) for _ in range(70)] + [(k, k + 1) for k in range(1000, 1064)] + [(5, 5)]
    u = UnionFind()
    for a, b in edges:
        if a != b:
            u.union(a, b)
    groups = {}
    for x, root in u.clusters().items():
        groups.setdefault(root, []).append(x)
    want = {x: min(g) for g in groups.values() for x in g}
    for few in (0, 100_000):  # by rounds of jobs, and at once
        rows = connected_components(spark.createDataFrame([*edges, (None, 1)], "left long, right long"), few=few).collect()
        assert {r.id: r.component for r in rows} == want and len(rows) == len(want)
    assert connected_components(spark.createDataFrame([], "left long, right long")).collect() == []


def merged(spans, strategy):
    out = []
    for a, b in sorted(set(spans), key=lambda s: (s[0], -s[1])):
        if strategy == "overlapping" and out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        elif strategy == "overlapping" or not out or b > out[-1][1]:
            out.append((a, b))
    return out


@pytest.mark.parametrize("strategy", ["overlapping", "longest"])
def test_merge(spark, strategy):
    r = random.Random(2)
    cases = [[(k, 10 + k) for k in range(7)] + [(7, 21)], [(0, 4), (2, 4), (4, 5)], [(0, 10)] * 5] + [[(a, a + r.randint(1, 6)) for a in (r.randint(0, 25) for _ in range(r.randint(1, 12)))] for _ in range(40)]
    rows = [(k, a, b) for k, c in enumerate(cases) for a, b in c]
    got = {}
    for x in intervals.merge_intervals(spark.createDataFrame(rows, "k long, start long, stop long"), ["k"], strategy).collect():
        got.setdefault(x.k, []).append((x.start, x.stop))
    assert all(sorted(got[k]) == merged(c, strategy) for k, c in enumerate(cases))
    with pytest.raises(ValueError):
        intervals.merge_intervals(spark.createDataFrame(rows, "k long, start long, stop long"), ["k"], "other")


def test_restore(spark):
    bounds = spark.createDataFrame([(0, 0, 10), (1, 10, 20)], "doc_id long, begin long, end long")
    spans = spark.createDataFrame([(0, 5), (5, 10), (5, 15), (5, 19)], "start long, stop long")
    got = sorted((r.doc_id, r.start, r.stop) for r in intervals.restore(spans, bounds, "doc_id").distinct().collect())
    assert got == [(0, 0, 5), (0, 5, 10), (1, 0, 5), (1, 0, 9)]
    for strategy in ("longest", "overlapping"):
        rows = intervals.restore_and_merge(spans, bounds, 5, strategy, "doc_id").collect()
        if strategy == "overlapping":
            assert sorted((r.doc_id, r.start, r.stop) for r in rows) == [(0, 0, 10), (1, 0, 9)]
        assert sum(r.stop - r.start for r in rows) == 19


def test_restore_over_blocks(spark):
    """Spans longer than a block of the range join meet each document once."""
    docs = spark.createDataFrame([(k, "x" * 30_000) for k in range(10)], "doc_id long, text string")
    bounds = intervals.boundaries(docs, index="doc_id", group=3)
    rows = intervals.restore(spark.createDataFrame([(10, 299_000)], "start long, stop long"), bounds, "doc_id").collect()
    assert sorted((r.doc_id, r.start, r.stop) for r in rows) == [(0, 10, 30_000)] + [(k, 0, 30_000) for k in range(1, 9)] + [(9, 0, 29_000)]


def test_cut_out(spark):
    rows = [("This is a test.", [(0, 4), (5, 7)]), ("é" * 3, [(1, 4)]), ("abc", None), (None, [(0, 1)]), ("abcdef", [(0, 4), (2, 5)])]
    df = spark.createDataFrame(rows, "t string, s array<struct<start:long,stop:long>>")
    assert [r.x for r in df.select(intervals.cut_out("t", "s").alias("x")).collect()] == ["  a test.", "é", "abc", None, "f"]


@pytest.mark.parametrize("length", [1, 5, 12, 30])
def test_repeated_windows(spark, length):
    r = random.Random(length)
    shared = "".join(r.choice("abcdé") for _ in range(45))
    texts = ["".join(r.choice("abcdé") for _ in range(r.randint(0, 50))) + (shared[r.randint(0, 9) :] if k % 3 == 0 else "") for k in range(24)] + ["", None, "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz"]
    seen = {}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        for i in range(len(data) - length + 1):
            seen.setdefault(data[i : i + length], []).append((k, i))
    want = {p for places in seen.values() if len(places) > 1 for p in places}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [(x.doc_id, x.start) for x in substring.repeated_windows(docs, length, index="doc_id").collect()]
    assert set(rows) == want and len(rows) == len(want)
    kept = {x.doc_id: x.text for x in substring.remove_repeats(docs, length, index="doc_id").collect()}
    for k, t in enumerate(texts):
        data, gone = (t or "").encode(), {i + j for d, i in want if d == k for j in range(length)}
        left = bytes(b for i, b in enumerate(data) if i not in gone).decode("utf-8", "ignore")
        assert kept.get(k, "") == left


def test_replayed_roots(spark):
    """Clusters agree with the least-id form; the root is that of a plain replay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    c = queries.SH
    groups = lambda rows: {frozenset([root, *ids]) for root, ids in rows.items()}

    def by(kind):
        out = {}
        for r in simhash.clusters(docs, c, kind).collect():
            out.setdefault(r.cluster, []).append(r.id)
        return out

    least, replay = by("least"), by("replay")
    assert groups(least) == groups(replay)
    for root, ids in replay.items():
        if len(ids) == 1:
            assert root > ids[0]  # of a plain pair the later one is the root


def test_short_documents_share_a_signature(spark):
    docs = spark.createDataFrame([(0, "one two"), (1, ""), (2, "a b c d e f g h"), (3, None)], "doc_id long, text string")
    rows = {r.id: r.lo for r in simhash.signatures(docs, queries.SH).collect()}
    assert rows[0] == rows[1] == 0 and rows[2] != 0 and 3 not in rows


def test_wide_signatures(spark):
    docs = spark.createDataFrame([(0, "a b c d e f g h i j")], "doc_id long, text string")
    for f in (64, 128):
        c = simhash.SimHash(f=f, index_column="doc_id")
        row = simhash.signatures(docs, c).first()
        words = "a b c d e f g h i j".split()
        want = hashing.vote([hashing.xxh3_bits(" ".join(words[i : i + 3]).encode(), bits=f) for i in range(8)], f)
        assert (row.hi % (1 << 64)) << 64 | row.lo % (1 << 64) == want


def test_minhash_drops_short_ones(spark):
    docs = spark.createDataFrame([(0, "one two"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "__INDEX__ long, text string")
    rows, found = pipelines.run_minhash(docs, minhash.MinHash(num_perm=16, bands=4, rows=4))
    assert [r["__INDEX__"] for r in rows.collect()] == [1] and found.count() == 2
    rows, _ = pipelines.run_minhash(docs, minhash.MinHash(num_perm=16, bands=4, rows=4), filtering=False)
    assert {r["__INDEX__"]: r["__duplicate__"] for r in rows.collect()} == {1: True, 2: True}


def test_minhash_shape():
    with pytest.raises(ValueError):
        _ = minhash.MinHash(num_perm=16, bands=5).shape
    with pytest.raises(ValueError):
        simhash.SimHash(num_bucket=3)


def test_strict_simhash_keeps_what_the_first_flags_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("doc_id", "__INDEX__")
    c = simhash.SimHash(hash_func="sha1")
    plain, _ = pipelines.run_simhash(docs, c, strict=True)
    checked, found = pipelines.run_simhash(docs, c, verify=True, strict=True)
    key = lambda df: sorted(r["__INDEX__"] for r in df.collect())
    assert key(plain) == key(checked)
    assert found.count() <= simhash.clusters(docs, c).count()


def test_rand_index(spark):
    rows = [(1, 1), (1, 1), (2, 2), (2, 2)]
    assert evaluate.adjusted_rand(spark.createDataFrame(rows, "truth long, found long")).first().ari == 1.0
    rows = [(0, 0), (0, 0), (1, 0), (1, 1)]
    assert evaluate.adjusted_rand(spark.createDataFrame(rows, "truth long, found long")).first().ari == pytest.approx(0.0)


def test_predictions(spark):
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, name string")
    full = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (9, 1)], "id long, cluster long")
    assert {r.name: set(r.found) for r in evaluate.predictions(full, names).collect()} == {"a": {"b", "c"}, "b": {"a", "c"}, "c": {"a", "b"}}
    child = spark.createDataFrame([(1, 0)], "id long, cluster long")
    assert {r.name: r.found for r in evaluate.predictions(evaluate.with_roots(child), names).collect()} == {"a": ["b"], "b": ["a"]}


def test_ground_truth(spark):
    rows = [("a", ["b", "b", "c"]), ("b", []), ("c", None)]
    got = evaluate.ground_truth(spark.createDataFrame(rows, "core_id string, labelled_duplicates array<string>")).collect()
    assert {r.name: r.truth for r in got} == {"a": ["b", "c"], "b": [], "c": []}


def test_total_size(spark):
    spans = spark.createDataFrame([(0, 0, 5), (0, 3, 9), (1, 2, 2)], "__INDEX__ long, start long, stop long")
    assert intervals.total_size(spans).first().size == 11
    assert intervals.total_size(spans.where("start > 99")).first().size == 0


def test_simhash_report_of_no_clusters(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "__INDEX__ long, text string")
    c = simhash.SimHash()
    assert simhash.verification_report(docs, simhash.clusters(docs, c), c).first().asDict() == dict.fromkeys(["clusters", "candidate_pairs", "false_positives", "true_positives", "true_clusters"], 0)


def test_treemap_of_nothing(spark):
    got = report.treemap(spark.createDataFrame([], "id long, cluster long, text string")).collect()
    assert [tuple(r) for r in got] == [("All Clusters", "", 0, "Total: 0 records")]


def test_io(spark, tmp_path):
    rows = [(k * 3 % 10, f"t{k}") for k in range(10)]
    spark.createDataFrame(rows, "k long, text string").repartition(3).write.parquet(str(tmp_path / "in"))
    df = io.load(spark, str(tmp_path / "in"), order=["k"], split="train[:50%]")
    assert sorted((r.k, r["__INDEX__"]) for r in df.collect()) == [(k, k) for k in range(5)]
    assert sorted(r["__INDEX__"] for r in io.load(spark, str(tmp_path / "in")).collect()) == list(range(10))
    marked = df.withColumn("__CLUSTER__", F.col("__INDEX__"))
    for index, cluster, mapping in ((False, False, False), (True, False, False), (False, True, False), (True, True, False), (False, False, True)):
        io.save(marked, str(tmp_path / "out"), df.select("k"), keep_index=index, keep_cluster=cluster, save_clusters=mapping)
        cols = spark.read.parquet(str(tmp_path / "out/data")).columns
        assert ("__INDEX__" in cols, "__CLUSTER__" in cols) == (index or mapping, cluster or mapping)
    with pytest.raises(io.NotATable):
        io.check_table({"train": df})


@pytest.mark.parametrize("name", ["minhash", "simhash", "bloom_filter", "suffix_array"])
def test_run_from_toml(spark, tmp_path, name):
    extra = {"minhash": "num_perm = 32\nthreshold = 0.5\ncheck_false_positive = true", "simhash": "check_false_positive = true", "bloom_filter": "max_elements = 100\nerror_rate = 0.1", "suffix_array": "length_threshold = 50"}[name]
    path = tmp_path / "c.toml"
    path.write_text(f'[input]\npath = "{SF}/documents.parquet"\norder = ["doc_id"]\n[algorithm]\nalgorithm_name = "{name}"\ntext_column = "text"\n{extra}\n[output]\noutput_dir = "{tmp_path}/out"\nsave_clusters = true\n')
    got = pipelines.run(spark, load_config(str(path)))
    assert 0 < got["after"] < got["before"] == 200


def test_config_errors(tmp_path):
    path = tmp_path / "c.toml"
    for text in ("[input]\npath='x'", "[input]\npath='x'\n[algorithm]\nalgorithm_name='z'\n[output]\noutput_dir='y'", "[input]\npath='x'\n[algorithm]\nalgorithm_name='minhash'\ntext_column='t'\nodd=1\n[output]\noutput_dir='y'"):
        path.write_text(text)
        with pytest.raises(ValueError):
            load_config(str(path))


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",), ("a",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = first_seen(spark.readStream.schema("text string").parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.text for r in spark.table("seen").collect()) == ["a", "b"]


def test_own_columns_stay(spark):
    """Columns that runs use names like stay, and the configured names are used."""
    rows = [(k, f"one two three four five six {k // 2}", k % 3, "x") for k in range(8)]
    docs = spark.createDataFrame(rows, "rowid long, text string, cluster long, id string")
    c = minhash.MinHash(num_perm=16, bands=4, rows=4, index_column="rowid", cluster_column="grp")
    kept, _ = pipelines.run_minhash(docs, c, verify=True)
    assert {"cluster", "id", "grp"} <= set(kept.columns) and {(r.rowid, r.cluster) for r in kept.collect()} <= {(k, k % 3) for k in range(8)}
    kept, _ = pipelines.run_simhash(docs, simhash.SimHash(index_column="rowid", cluster_column="grp"), verify=True)
    assert {"cluster", "id", "grp"} <= set(kept.columns) and kept.count() >= 1


def test_configured_names_and_arguments(spark, tmp_path):
    spark.createDataFrame([(f"a b c d e f {k // 2}",) for k in range(6)], "text string").write.csv(str(tmp_path / "in"), header=True)
    path = tmp_path / "c.toml"
    path.write_text(f"""[input]
input_type = "local_files"
file_type = "csv"
[input.read_arguments]
data_files = "{tmp_path}/in"
split = "train"
header = true
[algorithm]
algorithm_name = "minhash"
text_column = "text"
num_perm = 16
bands = 4
rows = 4
index_column = "rowid"
cluster_column = "grp"
[output]
output_dir = "{tmp_path}/out"
clean_cache = true
""")
    assert pipelines.run(spark, load_config(str(path)))["before"] == 6
    out = spark.read.parquet(f"{tmp_path}/out/data")
    assert set(out.columns) == {"text", "__duplicate__"} and out.count() == 3


def test_a_text_of_a_third_of_all_rows(spark):
    """Copies and nulls without end burden no window: each task's share of what is shuffled is small."""
    docs = spark.range(0, 30_000, numPartitions=4).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same six words in each").when(F.col("id") % 3 == 1, F.concat_ws(" ", *[F.hex(F.hash("id", F.lit(k))) for k in range(6)])).alias("text"))
    flags = exact.flag_copies(docs, index="doc_id")
    assert "Window" not in flags._jdf.queryExecution().executedPlan().toString()
    assert flags.where("duplicate").count() == 9_999 and flags.count() == 30_000
    found = minhash.clusters(docs, minhash.MinHash(num_perm=16, bands=4, rows=4, index_column="doc_id"))
    assert found.count() == 10_000 and found.where("cluster <> 0").count() == 0


def test_exact_rows(spark):
    docs = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None), (5, "")], "__INDEX__ long, text string")
    assert sorted(r["__INDEX__"] for r in exact.keep_first(docs).collect()) == [1, 2, 4, 5]


def test_explore_and_compare(spark):
    rows = spark.createDataFrame([(0, 0, "x y"), (1, 0, "x z"), (2, 2, "w")], "id long, cluster long, text string")
    assert [r.id for r in report.explore(rows, 0, 1).collect()] == [0]
    assert sorted(r.id for r in report.compare(rows, 0, 2).collect()) == [0, 1, 2]
    assert [r.id for r in report.search(rows, "X").orderBy("id").collect()] == [0, 1]
    assert report.summary(rows.where("id < 0")).first().records == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("block", [300, 2000, within.BLOCK])
def test_clusters_by_tiles(spark, block):
    """Best matches and components within clusters, by brute force; small blocks make many tiles of a cluster."""
    r = random.Random(block)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(60):
        words = [w if r.random() > 0.1 * (k % 4) else f"x{r.randint(0, 30)}" for w in base[: r.randint(6, 40)]]
        rows.append((k, k % 3 if k < 57 else 100 + k, None if k == 5 else " ".join(words) if k % 7 else "the same seven words as in others"))
    df = spark.createDataFrame(rows, "id long, cluster long, text string")
    grams = lambda t: {tuple(t.split()[i : i + 2]) for i in range(len(t.split()) - 1)}
    share = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    near = {(a, b): share(t, u) for a, c, t in rows for b, d, u in rows if a != b and c == d and t and u}
    sets, one = within.compared(df, 2, 5)
    for threshold in (0.0, 0.6):
        got = {(x.cluster, bytes(x.k)): x.best for x in within.best_matches(sets, one, threshold, block).collect()}
        for x in sets.collect():
            want = max((v for (a, b), v in near.items() if a == x.id and grams(rows[b][2]) != grams(rows[a][2])), default=None)
            if want is not None and want >= threshold:
                assert got[x.cluster, bytes(x.k)] == want
            else:
                assert got.get((x.cluster, bytes(x.k)), -1) < threshold or want is None
        edges = within.near_edges(sets, one, threshold, block).unionAll(within.copy_edges(sets, one))
        joined = UnionFind()
        for (a, b), v in near.items():
            if v >= threshold:
                joined.union(a, b)
        assert {frozenset(g) for g in _parts((a, joined.find(a)) for a in joined.above)} == {frozenset(g) for g in _parts((x.id, x.component) for x in connected_components(edges).collect())}
    similar = {x.id: (x.best, x.false_positive) for x in report.cluster_similarity(df, 2, 0.6).collect()}
    assert set(similar) == set(range(57)) and similar[5] == (None, None)
    for a in set(range(57)) - {5}:
        best = max(v for (x, _), v in near.items() if x == a)
        assert similar[a] == (best, best < 0.6)


def _parts(pairs):
    out = {}
    for a, root in pairs:
        out.setdefault(root, set()).add(a)
    return out.values()


@pytest.mark.parametrize("many", [1, 5_000])
def test_repeated_ranges(spark, many):
    """Periodic texts, copies, passages within others, and anchors of many runs, by brute force."""
    r = random.Random(many)
    word = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    passage, line = word(70), word(12)
    texts = ["z" * 200, "ab" * 60, line * 9, passage, passage, word(30) + passage + word(30), word(9) + passage[20:] + word(50), None, "", word(30) + line * 3 + word(40)]
    texts += [word(25) + passage[r.randint(0, 20) : r.randint(40, 70)] + word(25) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length in (1, 8, 30):
        seen = {}
        for k, t in enumerate(texts):
            data = (t or "").encode()
            for i in range(len(data) - length + 1):
                seen.setdefault(data[i : i + length], []).append((k, i))
        want = sorted(p for places in seen.values() if len(places) > 1 for p in places)
        got = substring.repeated_ranges(docs, length, index="doc_id", many=many).collect()
        assert sorted((x.doc_id, s) for x in got for s in range(x.first, x.last)) == want
    plan = substring.repeated_spans(docs, 30, index="doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "hash" not in plan.lower().replace("hashpartitioning", "")  # no row for each window


def test_pairs_by_tiles(spark, monkeypatch):
    """All pairs of buckets with their similarities, against the plain joins; small limits cut tiles and batches."""
    r = random.Random(3)
    base = [f"w{k}" for k in range(30)]
    texts = [" ".join(w if r.random() > 0.15 * (k % 3) else f"x{k}" for w in base[: r.choice([12, 30])]) for k in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:9] + [texts[0]] * 5)), "__INDEX__ long, text string")
    c = minhash.MinHash(num_perm=16, bands=8, rows=2, ngram=2)
    sets = {x["__INDEX__"]: set(x.g) for x in docs.select("__INDEX__", minhash.grams(c).alias("g")).collect()}
    want = sorted((x.left, x.right, len(sets[x.left] & sets[x.right]) / len(sets[x.left] | sets[x.right])) for x in minhash.pair_edges(minhash.band_rows(docs, c)).collect())
    monkeypatch.setattr(within, "_PAIRS", 7)
    found = minhash.pair_similarities(docs, c)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]  # pairs are joined with nothing
    assert sorted(map(tuple, found.collect())) == want and len(want) > 100
    monkeypatch.setattr(within.pairs, "__defaults__", (600,))
    assert sorted(map(tuple, minhash.pair_similarities(docs, c).collect())) == want


def test_query_of_pairs_is_its_sql(spark):
    test_query_is_its_sql(spark, "pair_jaccard")
    test_query_is_its_sql(spark, "cluster_jaccard")


def test_labels_are_compared_as_sets(spark):
    """Counts by label say what the lists say, and no list is made."""
    r = random.Random(6)
    truth = [(str(k), f"t{r.randint(0, 12)}") for k in range(60)]
    label = [(str(k), r.choice([None, int(truth[k][1][1:]) % 5, r.randint(0, 40)])) for k in range(50)]
    sets = lambda rows: {a: sorted(b for b, m in rows if m == l and b != a) if l is not None else [] for a, l in rows}
    lists = [spark.createDataFrame(list(sets(rows).items()), f"name string, {c} array<string>") for rows, c in ((truth, "truth"), (label, "found"))]
    want = {x.name: (len(x.truth), len(x.found), len(set(x.truth) & set(x.found)), x["class"], x.exact) for x in evaluate.compare(*lists).collect()}
    got = evaluate.compare_labels(spark.createDataFrame(truth, "name string, label string"), spark.createDataFrame(label, "name string, label int"))
    assert {x.name: tuple(x)[1:] for x in got.collect()} == want and len(want) == 60
    assert {k for *_, k, _ in want.values()} >= {"FP", "FN"}
    assert "collect" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_replay_of_copies():
    """Thousands of copies meet their first one only, and the roots are those of a plain replay."""
    r = random.Random(7)
    c = simhash.SimHash()
    seen = [r.getrandbits(63) & ~0xFFFF for _ in range(2)]
    rows = [(k, 0, r.choice(seen) ^ r.choice([0, 0, 1, 6, 1 << 20])) for k in range(300)]
    forest, buckets = UnionFind(), {}
    for doc, _, sig in rows:
        for mask in hashing.block_keys(64, 4, 3):
            for other, other_sig in buckets.get((mask, sig & mask), []):
                if (sig ^ other_sig).bit_count() <= 3:
                    forest.union(doc, other)
            buckets.setdefault((mask, sig & mask), []).append((doc, sig))
    replay = simhash._replay(c)
    got = replay(pd.DataFrame(rows, columns=["id", "hi", "lo"]))
    assert dict(zip(got.id, got.component)) == {k: forest.find(k) for k, *_ in rows}
    began = time.process_time()
    replay(pd.DataFrame([(k, 0, 5) for k in range(20_000)], columns=["id", "hi", "lo"]))
    assert time.process_time() - began < 20  # all pairs are 800 million meetings
