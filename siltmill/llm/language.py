"""Language ID: a text's likelihood fused with what is known beside the text.

Text likelihood: naive Bayes over hashed byte triples, fitted on a bounded sample of labelled rows,
with a class of no language whose triples are uniform. The text's own posterior for every document
then gives, by grouped aggregation over the whole table, how each declared markup language, address
suffix and host goes with the languages. A host's prior is smoothed towards its registered domain's,
that towards its suffix's, and that towards the whole table's. The last pass adds the logarithms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmill.llm.text import slices
from siltmill.session import discard, written

#: Labelled rows of a language that the text model is fitted on, at most.
ROWS_PER_LANGUAGE = 400
#: Bytes of their texts, at most, but for one text.
BYTES_PER_LANGUAGE = 1 << 22
HASH_BITS = 16
#: Text evidence counts by so much: triples that overlap aren't independent.
TEMPER = 0.3
#: Rows that a parent's distribution counts as, in its child's.
PSEUDO = 20.0
#: A document is rejected where no language reaches this posterior.
LEAST_POSTERIOR = 0.7
NONE = "und"
_KEY = np.uint32(0x9E3779B1)


def triples(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte triples of all texts, in lower case and with a space around, and how many each has.

    Digits and the ASCII signs say nothing of a language; where one stands, no triple counts. A text
    without letters has none, and neither has a null one."""
    raw = [b" " + t.lower().encode() + b" " if t else b"" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    if len(data) < 3:
        return np.empty(0, np.uint32), np.zeros(len(raw), np.int64)
    d = data.astype(np.uint32)
    h = ((d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)) * _KEY) >> np.uint32(32 - HASH_BITS)
    ok = _SAYS[data]
    good = ok[:-2] & ok[1:-1] & ok[2:]
    letters = data > 32
    good &= letters[:-2] | letters[1:-1] | letters[2:]
    ends = np.cumsum(lens)
    for back in (1, 2):  # triples that would run into the next text
        cut = ends[lens > 0] - back
        good[cut[cut < len(good)]] = False
    sums = np.concatenate([[0], np.cumsum(good)])
    at = np.concatenate([[0], ends]).clip(0, len(good))
    return h[good], np.diff(sums[at])


_SAYS = np.array([b >= 128 or chr(b).isalpha() or b in b" '" for b in range(256)])


class TextModel:
    """Log-probabilities of hashed triples for each language, and uniform ones for no language."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> TextModel:
        by: dict[str, list[str]] = {}
        for text, language in rows:
            by.setdefault(language, []).append(text)
        languages = sorted(by)
        size = 1 << HASH_BITS
        table = np.empty((size, len(languages) + 1), np.float32)
        for i, language in enumerate(languages):
            counts = np.bincount(triples(by[language])[0], minlength=size) + 0.05
            table[:, i] = np.log(counts / counts.sum())
        table[:, -1] = -np.log(size)
        return cls([*languages, NONE], table)

    def log_likelihood(self, texts: list[str | None]) -> np.ndarray:
        """texts x languages; zeros for a text that says nothing."""
        h, counts = triples(texts)
        out = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(counts)
        if len(some):
            starts = (np.cumsum(counts) - counts)[some]
            for i in range(len(self.languages)):
                out[some, i] = np.add.reduceat(self.table[:, i][h].astype(np.float64), starts)
        return out


def fit_text_model(docs: DataFrame, text_col: str, label_col: str, id_col: str, rows: int = ROWS_PER_LANGUAGE, size: int = BYTES_PER_LANGUAGE) -> TextModel:
    """Fit on at most rows texts of each label and size bytes of them, those of the least id hashes.

    Every label is a language, however few its rows. Null and empty labels, null ids and null texts are left out."""
    light = docs.select(F.col(id_col).alias("i"), F.col(label_col).cast("string").alias("l")).where(F.col("i").isNotNull() & (F.col("l") != ""))
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("i"), "i"))
    chosen = written(light.withColumn("r", rank).where(F.col("r") <= rows).select("i", "l"))  # its size is known where it is joined
    texts = docs.select(F.col(id_col).alias("d"), F.col(label_col).cast("string").alias("m"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    found = texts.join(chosen, (F.col("d") == F.col("i")) & (F.col("m") == F.col("l")), "left_semi")
    before = F.sum(F.octet_length("t")).over(Window.partitionBy("m").orderBy(F.xxhash64("d"), "d", "t").rowsBetween(Window.unboundedPreceding, -1))
    kept = found.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < size).select("t", "m").collect()
    discard(chosen)
    return TextModel.fit([(r.t, r.m) for r in kept])


def host_of(url: Column) -> Column:
    """Host in lower case, without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _shares(counts: DataFrame, key: list[str], parent: DataFrame | None, n: int) -> DataFrame:
    """Distributions by key, each with PSEUDO rows of its parent's; parent: its own keys and a column p."""
    total = counts.groupBy(*key).agg(*[F.coalesce(F.sum(F.col("c")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(n)])
    if parent is None:
        joined = total.withColumn("q", F.array(*[F.lit(1.0 / n)] * n))
    else:
        shared = [c for c in parent.columns if c != "p"]
        up = parent.withColumnRenamed("p", "q")
        joined = total.join(up, shared) if shared else total.crossJoin(up)
    whole = sum((F.col(f"s{i}") for i in range(n)), F.lit(0.0))
    p = F.array(*[(F.col(f"s{i}") + PSEUDO * F.col("q")[i]) / (whole + PSEUDO) for i in range(n)])
    return joined.select(*key, p.alias("p"))


def _evidence(docs: DataFrame, id_col: str, text_col: str, declared: Column | None, host: Column | None, model: TextModel, row: bool = False) -> DataFrame:
    """(id, ll, declared, host, domain, suffix) of each row of docs, and with row all its columns in row_."""
    n = len(model.languages)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is that of the hashed table

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for col in batches:
            parts = [pa.array([], pa.list_(pa.float64()))]
            for part in slices(col):
                ll = model.log_likelihood(part) * TEMPER
                parts.append(pa.ListArray.from_arrays(pa.array(np.arange(0, ll.size + 1, n), pa.int32()), pa.array((ll - ll.max(1, keepdims=True)).ravel())))
            yield pa.concat_arrays(parts)

    none = F.lit(None).cast("string")
    host = (none if host is None else host).cast("string")
    parts = F.split(host, r"\.")
    many = F.size(parts)
    return docs.select(
        F.col(id_col).alias("id"),
        F.arrow_udf(run, "array<double>")(F.col(text_col)).alias("ll"),
        F.lower((none if declared is None else declared).cast("string")).alias("declared"),
        host.alias("host"),
        F.when(many >= 2, F.concat_ws(".", F.slice(parts, -2, 2))).otherwise(host).alias("domain"),
        F.when((many >= 2) & (F.element_at(parts, -1) != ""), F.element_at(parts, -1)).alias("suffix"),
        *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")] * row,
    )


def _learned(light: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((host, hp), (declared, d), (ap)): what all rows of light say of hosts, declarations, and in general."""
    # the text's own posterior for every row is what the counts below add up
    top = F.array_max("ll")
    e = F.transform("ll", lambda x: F.exp(x - top))
    share = F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
    # a text that says nothing counts nothing, but its host still gets a prior, its parents'
    silent = F.array(*[F.lit(0.0)] * n)
    soft = light.select("declared", "host", "domain", "suffix", F.when(F.array_min("ll") < 0, share).otherwise(silent).alias("c"))
    keys = ["suffix", "domain", "host", "declared"]
    by = soft.groupBy(*keys).agg(*[F.sum(F.col("c")[i]).alias(f"s{i}") for i in range(n)])
    counts = written(by.select(*keys, F.array(*[f"s{i}" for i in range(n)]).alias("c")))
    all_ = _shares(counts, [], None, n)
    suffixes = _shares(counts, ["suffix"], all_, n)
    known = counts.where(F.col("host").isNotNull())
    domains = _shares(known.withColumn("suffix", F.coalesce("suffix", F.lit(""))), ["suffix", "domain"], suffixes.withColumn("suffix", F.coalesce("suffix", F.lit(""))), n)
    hosts = _shares(known.withColumn("suffix", F.coalesce("suffix", F.lit(""))), ["suffix", "domain", "host"], domains, n)
    told = counts.where(F.col("declared").isNotNull()).groupBy("declared").agg(*[F.sum(F.col("c")[i]).alias(f"s{i}") for i in range(n)])
    sums = counts.where(F.col("declared").isNotNull()).agg(*[F.sum(F.col("c")[i]).alias(f"t{i}") for i in range(n)])
    # P(declared | language), with one row of every declaration in the table's own proportion
    whole = sum((F.col(f"s{i}") for i in range(n)), F.lit(0.0))
    overall = sum((F.coalesce(F.col(f"t{i}"), F.lit(0.0)) for i in range(n)), F.lit(0.0))
    said = told.where(whole > 0).crossJoin(sums).select(
        "declared", F.array(*[F.log((F.col(f"s{i}") + whole / overall) / (F.coalesce(F.col(f"t{i}"), F.lit(0.0)) + 1.0)) for i in range(n)]).alias("d")
    )
    # written, so that their sizes are known where they are joined
    out = written(hosts.select("host", F.col("p").alias("hp"))), written(said), all_.select(F.col("p").alias("ap"))
    return out


def _fused(light: DataFrame, learned: tuple[DataFrame, DataFrame, DataFrame], languages: list[str], least_posterior: float, *carry: str) -> DataFrame:
    """(carry, language, posterior, keep) of each row of light."""
    hosts, said, all_ = learned
    n = len(languages)
    prior = F.coalesce(F.col("hp"), F.col("ap"), F.array(*[F.lit(1.0 / n)] * n))
    fused = light.join(hosts, "host", "left").join(said, "declared", "left").join(F.broadcast(all_), how="left")  # all_ is one row
    zero = F.array(*[F.lit(0.0)] * n)
    d = F.coalesce(F.col("d"), zero)
    score = F.array(*[F.col("ll")[i] + F.log(prior[i]) + d[i] for i in range(n)])
    best = F.array_max("score")
    scored = fused.select(*carry, score.alias("score"))
    posterior = 1.0 / F.aggregate(F.transform("score", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, b: a + b)
    names = F.array(*[F.lit(x) for x in languages])
    out = scored.select(*carry, F.element_at(names, F.array_position("score", best).cast("int")).alias("language"), posterior.alias("posterior"))
    return out.withColumn("keep", (F.col("language") != NONE) & (F.col("posterior") >= least_posterior))


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: Column | None = None,
    host: Column | None = None,
    model: TextModel | None = None,
    label_col: str = "lang",
    least_posterior: float = LEAST_POSTERIOR,
) -> DataFrame:
    """(id, language, posterior, keep) for each row.

    declared is the column of the language that the markup declares, host the one of the host's name;
    either may be null, in all rows or some, and says nothing there. The text model is fitted on
    label_col where none is given. language is the likeliest one ('und': none), ties going to the
    first by name; keep says that it is a language with least_posterior. A null or empty text, or one
    without letters, is judged by the other evidence; with none at all it has the table's own shares,
    and without any row that says something all are alike. A text of any length counts with all its triples.
    Each row is judged by itself, so repeated
    rows and null ids stay; an empty table gives an empty one, other columns are left out.
    """
    if model is None:
        model = fit_text_model(docs, text_col, label_col, id_col)
    light = written(_evidence(docs, id_col, text_col, declared, host, model))
    found = _fused(light, _learned(light, len(model.languages)), model.languages, least_posterior, "id")
    return found.withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, model: TextModel | None = None, label_col: str = "lang", least_posterior: float = LEAST_POSTERIOR) -> DataFrame:
    """The rows of docs whose language is known, with its columns; see identify().

    Each row carries its own decision: null and repeated ids, repeated rows and ties make no difference to it, and
    texts of any length are read whole. A null or empty text stays where the other evidence tells its language.
    An empty table gives an empty one. Texts are scored twice, for the counts and for the decision, so that
    they are neither written nor joined by id."""
    if model is None:
        model = fit_text_model(docs, text_col, label_col, id_col)
    learned = _learned(_evidence(docs, id_col, text_col, declared, host, model), len(model.languages))
    rows = _evidence(docs, id_col, text_col, declared, host, model, row=True)
    return _fused(rows, learned, model.languages, least_posterior, "row_").where("keep").select("row_.*")
