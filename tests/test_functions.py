"""Scalar functions against literal values and plain Python."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from siltmill.functions import hashing
from siltmill.functions import text as T
from siltmill.operators.unionfind import UnionFind


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def grams(spark, words, n, least=5):
    return spark.createDataFrame([(words,)], "w array<string>").select(T.ngrams(F.col("w"), n, least).alias("x")).first().x


@pytest.mark.parametrize(
    ("words", "n", "least", "want"),
    [
        (list("abcde"), 3, 5, ["a b c", "b c d", "c d e"]),
        (list("abc"), 2, 5, []),
        (list("abcdef"), 8, 5, ["a b c d e f"]),
        (list("abcde"), 0, 5, []),
        ([], 2, 0, [""]),
        (["a"], 1, 0, ["a"]),
        (None, 2, 0, None),
    ],
)
def test_ngrams(spark, words, n, least, want):
    assert grams(spark, words, n, least) == want


def test_negative_ngrams(spark):
    with pytest.raises(ValueError):
        T.ngrams(F.col("w"), -1)


def test_tokens_read_unicode(spark):
    text = "Déjà vu! naïve_x ½ x² ‿ क़िला İstanbul‍z 42"
    assert one(spark, T.tokens("t"), t=text) == [w for w in regex.split(r"\W", text.lower()) if w]


def test_ngram_set_is_a_set(spark):
    assert one(spark, T.ngram_set("t", 1, 0), t="A a b, B c") == ["a", "b", "c"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("Hello, 123!", "hello 000"), ("2023-01-15", "00000000"), ("Test © 2023", "test  0000"), ("a​b", "ab"), ("  ", ""), ("", ""), ("Hello, 123!\n\t\b", "hello 000\n\t".strip()), ("Ünï ٣", "ünï 0")],
)
def test_normalize(spark, given, want):
    assert one(spark, T.normalize("t"), t=given) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("Test-\nword and\nnormal newline", "Testword and normal newline"), ("café résumé", "caf rsum"), ("well-known", "well-known"), ("a\\b [c] 'd' \"e\"", "ab c d e")],
)
def test_news(spark, given, want):
    assert one(spark, T.news_text("t"), t=given) == want


def test_title_and_abstract(spark):
    rows = spark.createDataFrame([("On A", "We Do"), (None, "X"), ("Y", None)], "t string, a string").select(T.title_and_abstract("t", "a").alias("p")).collect()
    assert [r.p for r in rows] == ["on a we do", " x", "y "]


def test_digests(spark):
    assert one(spark, T.digest("t"), t="hello world") == "5eb63bbbe01eeed093cb22bb8f5acdc3"
    assert one(spark, T.digest("t"), t="") == "d41d8cd98f00b204e9800998ecf8427e"
    assert bytes(one(spark, T.digest("t", "sha256", raw=True), t="x")) == hashlib.sha256(b"x").digest()


def test_sha1_numbers(spark):
    assert one(spark, hashing.sha1_u32("t"), t="hello world") == 896314922 == hashing.sha1_bits(b"hello world", 32)
    assert hashing.sha1_bits(b"hello world", 64) == 13028719972609469994
    assert hashing.sha1_bits(b"hello world", 128) == 310522945683037930239412421226792791594


def test_xxh3(spark):
    whole = xxhash.xxh3_64_intdigest(b"abc")
    assert hashing.xxh3_bits(b"abc", bits=32) == whole & 0xFFFFFFFF and hashing.xxh3_bits(b"abc", 1, 64) != whole
    assert all(hashing.xxh3_bits(b"abc", bits=b) < 1 << b for b in (16, 24, 40))
    assert one(spark, hashing.hash_column("t", "xxh3", 64), t="abc") % (1 << 64) == whole
    assert bytes(one(spark, hashing.hash_column("t", "xxh3", 128), t="abc")) == xxhash.xxh3_128_digest(b"abc")
    with pytest.raises(ValueError):
        hashing.hash_text("other", 32)


@pytest.mark.parametrize(("threshold", "perms", "want"), [(0.7, 240, (24, 10)), (0.5, 200, (33, 6)), (0.7, 128, (14, 9)), (0.5, 128, (25, 5))])
def test_lsh_shape(threshold, perms, want):
    assert hashing.lsh_shape(threshold, perms) == want


def test_permutations():
    a, b = hashing.permutations(240)
    assert a[0] == 2297359619001564596 and b[0] == 1207497806379370653


@pytest.mark.parametrize("bits", [64, 32, 16])
def test_minima_wrap(bits):
    r = random.Random(1)
    modulus, top = hashing.RINGS[bits]
    a, b = hashing.permutations(5, bits)
    h = [r.getrandbits(min(bits, 32)) for _ in range(20)]
    got = hashing.permuted_minima(np.array(h, np.uint64), np.array([0, 7]), a, b, bits)
    for row, part in zip(got, (h[:7], h[7:])):
        assert row.tolist() == [min((x * int(p) + int(q)) % (1 << bits) % modulus & top for x in part) for p, q in zip(a, b)]


def test_blocks():
    assert sum(hashing.block_widths(64, 13)) == 64
    r = random.Random(2)
    for f, blocks, k in ((64, 4, 3), (64, 13, 12), (128, 8, 7), (64, 12, 10)):
        masks = hashing.block_keys(f, blocks, k)
        for _ in range(100):
            x = sum(1 << p for p in r.sample(range(f), k))
            assert any(x & m == 0 for m in masks)
    with pytest.raises(ValueError):
        hashing.block_keys(64, 3, 3)


def test_bit_permutation():
    r = random.Random(3)
    p = hashing.BitPermutation(64, 3, [2, 0, 3, 1], [16] * 4)
    for _ in range(50):
        x = r.getrandbits(64)
        assert p.reverse(p.permute(x)) == x
    assert p.prefix == 16 and p.permute(0xFFFF << 16) == 0xFFFF << 48
    with pytest.raises(ValueError):
        hashing.BitPermutation(64, 3, [0, 1], [16, 16])


def test_vote():
    assert hashing.vote([13352372148217134600, 5020219685658847592], 64) == 74633958390507528
    assert hashing.vote([0, (1 << 8) - 1], 8) == 0
    with pytest.raises(ValueError):
        hashing.vote([], 8)


@pytest.mark.parametrize(("a", "b", "want"), [([], [], 1.0), (["x"], [], 0.0), (["hello", "world", "test"], ["hello", "foo", "bar"], 0.2)])
def test_jaccard(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(T.jaccard(F.col("a"), F.col("b")).alias("x")).first().x == want


@pytest.mark.parametrize(
    ("truth", "found", "p", "r", "kind"),
    [([], [], 0.0, 1.0, "TN"), (["a"], [], 0.0, 0.0, "FN"), (["a"], ["a", "b"], 0.5, 1.0, "TP"), (["a", "b"], ["a"], 1.0, 0.5, "FP"), ([], ["a"], 0.0, 1.0, "FP")],
)
def test_set_metrics(spark, truth, found, p, r, kind):
    df = spark.createDataFrame([(truth, found)], "t array<string>, f array<string>")
    t, f = F.col("t"), F.col("f")
    row = df.select(T.set_precision(t, f).alias("p"), T.set_recall(t, f).alias("r"), T.verdict(t, f).alias("k"), T.f1(T.set_precision(t, f), T.set_recall(t, f)).alias("f")).first()
    assert (row.p, row.r, row.k) == (p, r, kind) and row.f == (0.0 if p + r == 0 else 2 * p * r / (p + r))


def test_union_find():
    u = UnionFind()
    for a, b in ((1, 2), (3, 4), (2, 3), (1, 4), (8, 9)):
        u.union(a, b)
    assert u.find(4) == u.find(1) == 1 and u.find(9) == 8 and u.find(7) == 7
    assert u.clusters() == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 7: 7}
    u.reset()
    assert u.clusters() == {}


def test_word_runs_are_the_column_form(spark):
    r = random.Random(4)
    texts = ["", "a", "Déjà vu! naïve_x ½ x² ‿ क़िला z 42", "İstanbul ΑΣ ẞ ǅ"] + [" ".join(r.choice(["a", "B", "é,", "x-y", "٣"]) for _ in range(r.randint(0, 12))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for flavour in T.NON_WORD:
        for n, least in ((1, 0), (2, 0), (3, 5), (8, 5), (0, 0)):
            for row in df.select("i", T.ngram_set("t", n, least, flavour).alias("g")).collect():
                assert list(T.word_runs(texts[row.i], n, least, flavour)) == row.g


def test_words_are_counted_no_further_than_needed(spark):
    r = random.Random(5)
    texts = [None, "", "a", "-a-b", "Déjà vu! naïve_x ½ x² ‿ क़िला z 42", "İstanbul ΑΣ ẞ ǅ 𝒳"] + ["".join(r.choice(["a", "B", "é,", "--", " ", "\n", "٣"]) for _ in range(r.randint(0, 12))) for _ in range(60)]
    texts += [f"a{chr(k)}b" for k in range(1, 0x110000) if chr(k).lower() != chr(k)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for n in (0, 1, 2, 5, 200):
        assert df.where(~T.has_words("t", n).eqNullSafe(F.size(T.tokens("t")) >= n)).count() == 0
    plan = df.where(T.has_words("t", 5))._jdf.queryExecution().optimizedPlan().toString()
    assert "split" not in plan  # no list of all words


@pytest.mark.parametrize(("kind", "bits"), [("sha1", 16), ("sha1", 32), ("sha1", 64), ("xxh3", 16), ("xxh3", 32), ("xxh3", 64)])
def test_hashes_of_many_texts(kind, bits):
    texts = [b"", b"a", "é z".encode(), b"x" * 500]
    one = hashing.hash_text(kind, bits)
    assert hashing.hash_texts(kind, bits)(iter(texts)).tolist() == [one(x) for x in texts]
    assert len(hashing.hash_texts(kind, bits)([])) == 0


def test_texts_are_hashed_where_they_lie():
    texts = ["a", None, "", "é z", "x" * 300, None]
    for kind in (pa.string(), pa.large_string()):
        col = pa.array(texts, kind)
        for at in range(len(texts)):
            got = list(hashing.views(col.slice(at, 4)))
            assert [x if x is None else bytes(x).decode() for x in got] == texts[at : at + 4]
            assert all(x is None or isinstance(x, memoryview) for x in got)
    assert list(hashing.views(pa.array([], pa.string()))) == [] and list(hashing.views(pa.array([None], pa.string()))) == [None]
