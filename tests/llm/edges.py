"""A table of every awkward row, with columns whose names the operators use themselves."""

import random

from pyspark.sql import types as T

CLASHES = "id ids text_ route block kind seq data score keep kept_ language language_ group_id label sketch region same fingerprint near_id distance bin_id start piece piece_start length bucket rank rules n_ids decoded n_tokens covered longest repetition_ posterior toxic declared host ll i y t d f b k l words q c canonical_url blocked url tail hashed deeper cut common alike size unit first row_ h offset".split()
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.IntegerType()) for c in CLASHES]
)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(1, 9))) for _ in range(n))


LONG = prose(1, 60_000)
TEXTS = [
    (None, "an id that is null"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, prose(2, 80)), (5, prose(2, 80)), (6, prose(2, 80)), (7, LONG),
    (8, "x" * 200_000), (9, "a a a a a a a a a a a a a a a a a a a a"), (10, "日本語のテキスト、日本語のテキスト。"), (11, "🙂\x00​▁  two  spaces ▁"), (12, prose(2, 80).upper()), (13, " "), (14, prose(3, 200)), (15, "١٢٣ 123 %%% $$$"),
]


def table(spark, texts=None):
    rows = TEXTS if texts is None else texts
    langs = ["en", None, "fr", "", "zz"]
    data = [(i, t, langs[k % 5], None if k % 4 == 0 else f"s{k % 3}", None) + (None,) * len(CLASHES) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
