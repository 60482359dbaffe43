"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

A word's embedding is three rows of three hashed tables, side by side: two by hashes of the word,
so that words that share a row of one rarely share both, and one by the hash of its first letters,
which rare forms share with common ones. Filters of several widths run over the words, each keeps its largest value over the whole text, and a logistic unit adds those
up. Only the places of these largest values get a gradient, which keeps training cheap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmill.llm.text import Codes, mix, pieces
from siltmill.session import written

#: Labelled rows that the classifier is fitted on, at most: half of either class where there are enough.
TRAIN_ROWS = 16_000
#: Bytes of text that it is fitted on, at most, but for one text of each class; half of either class.
TRAIN_BYTES = 1 << 25
#: One labelled row in so many is never fitted on, so that there are some for the thresholds.
HELD_OUT = 5
BUCKETS = 1 << 16
#: Numbers in a row of each table, and first letters that the third one goes by.
PART = 6
STEM = 4
TABLES = 3
WIDTHS = (1, 2, 3)
FILTERS = 16
EPOCHS = 6
BATCH = 64
RATE = 0.15
SEED = 11
#: Toxic rows that the counts of all languages stand for in each language's own.
PSEUDO = 15.0
#: Scores are counted by their logits, in steps of 1 / STEPS between -SPAN and SPAN.
STEPS, SPAN = 100, 20
_WORD = re.compile(r"\w+")


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all words in lower case, how many each text has, the code's rows in the tables)."""
    codes, parts = Codes(), []
    for text in texts:
        parts.append(codes.of(_WORD.findall(text.lower())) if text else np.empty(0, np.int64))
    h = mix(np.fromiter((crc32(w.encode()) << 8 ^ len(w) for w in codes), np.uint64, len(codes)))
    stem = mix(np.fromiter((crc32(w[:STEM].encode()) << 8 ^ 255 for w in codes), np.uint64, len(codes)))
    rows = np.stack([h % np.uint64(BUCKETS), (h >> np.uint64(32)) % np.uint64(BUCKETS), stem % np.uint64(BUCKETS)], 1).astype(np.int64)
    return np.concatenate(parts) if parts else np.empty(0, np.int64), np.array([len(p) for p in parts], np.int64), rows


class Classifier:
    """Tables, filters and the logistic unit; all float32."""

    def __init__(self, seed: int = SEED):
        rng = np.random.RandomState(seed)
        d = TABLES * PART
        self.tables = [rng.normal(0, 0.3, (BUCKETS, PART)).astype(np.float32) for _ in range(TABLES)]
        self.filters = [rng.normal(0, 1 / np.sqrt(w * d), (w, d, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(-1.0)
        self.thresholds: dict[str | None, float] = {None: 0.5}

    def _words(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([t[rows[:, k]] for k, t in enumerate(self.tables)], 1)

    def _padded(self, codes: np.ndarray, counts: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes with max(WIDTHS) - 1 blanks after each text, the texts' starts, and the blanks' places."""
        gap = max(WIDTHS) - 1
        starts = np.cumsum(counts + gap) - counts - gap
        wide = np.full(int((counts + gap).sum()), none, np.int64)
        wide[np.arange(len(codes)) + np.repeat(np.arange(len(counts)) * gap, counts)] = codes
        return wide, starts, ((starts + counts)[:, None] + np.arange(gap)).ravel()

    def _conv(self, x: np.ndarray, k: int, blank: np.ndarray) -> np.ndarray:
        """Values of the k-th width's filters at each place, 0 at blanks; places past the end are blanks."""
        f = self.filters[k]
        out = x @ f[0]
        for j in range(1, len(f)):
            out[:-j] += x[j:] @ f[j]
        out[blank] = 0  # else a text's blanks would see the next text
        return out

    def scores(self, codes: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The probability of each text; 0 for one without words."""
        out = np.zeros(len(counts))
        some = np.flatnonzero(counts)
        words = np.concatenate([self._words(rows), np.zeros((1, TABLES * PART), np.float32)])
        ends = np.cumsum(counts)
        at = 0
        while at < len(some):  # some 30,000 words at a time stay within the cache
            first = ends[some[at]] - counts[some[at]]
            to = at + max(1, int(np.searchsorted(ends[some[at:]], first + 30_000)))
            part = some[at:to]
            wide, starts, blank = self._padded(codes[first : ends[part[-1]]], counts[part], len(rows))
            x = words[wide]
            top = np.concatenate([np.maximum.reduceat(self._conv(x, k, blank), starts, axis=0) for k in range(len(WIDTHS))], 1)
            z = np.maximum(top, 0) @ self.out + self.bias
            out[part] = 1 / (1 + np.exp(-z.astype(np.float64)))
            at = to
        return out

    def fit(self, texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Classifier:
        """Adagrad on the logistic loss, each class with half of the weight."""
        codes, counts, rows = hashed(texts)
        y = np.array(toxic, np.float32)
        some = np.flatnonzero(counts)
        if not len(some) or y[some].min() == y[some].max():
            return self  # nothing to tell apart: every text stays below the threshold
        share = y[some].mean()
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        begin = np.cumsum(counts) - counts
        rng = np.random.RandomState(seed)
        sums = [np.full((BUCKETS, PART), 1e-3, np.float32) for _ in range(TABLES)]
        fsums = [np.full_like(f, 1e-3) for f in self.filters]
        osum, bsum = np.full_like(self.out, 1e-3), 1e-3
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(some), max(1, len(some) // BATCH)):
                local = np.concatenate([codes[begin[i] : begin[i] + counts[i]] for i in batch])
                uniq, inv = np.unique(local, return_inverse=True)
                r = rows[uniq]
                words = np.concatenate([self._words(r), np.zeros((1, TABLES * PART), np.float32)])
                wide, starts, blank = self._padded(inv, counts[batch], len(uniq))
                x = words[wide]
                ends = np.append(starts[1:], len(wide))
                tops, places = [], []
                for k in range(len(WIDTHS)):
                    c = self._conv(x, k, blank)
                    best = np.stack([c[a:b].argmax(0) + a for a, b in zip(starts, ends)])
                    places.append(best)
                    tops.append(np.take_along_axis(c, best, 0))
                top = np.concatenate(tops, 1)
                act = np.maximum(top, 0)
                z = act @ self.out + self.bias
                g = (1 / (1 + np.exp(-z)) - y[batch]) * weight[batch] / len(batch)
                gout, gbias = g @ act, g.sum()
                gtop = (g[:, None] * self.out[None, :]) * (top > 0)
                gwords = np.zeros_like(words)
                for k, w in enumerate(WIDTHS):
                    gk = gtop[:, k * FILTERS : (k + 1) * FILTERS]
                    gf = np.zeros_like(self.filters[k])
                    for j in range(w):
                        place = np.minimum(places[k] + j, len(wide) - 1)
                        gf[j] = np.einsum("bfd,bf->df", x[place], gk)
                        np.add.at(gwords, wide[place].ravel(), (gk[:, :, None] * self.filters[k][j].T[None]).reshape(-1, TABLES * PART))
                    fsums[k] += gf * gf
                    self.filters[k] -= RATE * gf / np.sqrt(fsums[k])
                osum += gout * gout
                self.out -= RATE * gout / np.sqrt(osum)
                bsum += gbias * gbias
                self.bias -= np.float32(RATE * gbias / np.sqrt(bsum))
                for t in range(TABLES):
                    part = gwords[:-1, t * PART : (t + 1) * PART]
                    hit = np.flatnonzero((part != 0).any(1))
                    to, back = np.unique(r[hit, t], return_inverse=True)
                    grad = np.zeros((len(to), PART), np.float32)
                    np.add.at(grad, back, part[hit])
                    sums[t][to] += grad * grad
                    self.tables[t][to] -= RATE * grad / np.sqrt(sums[t][to])
        return self



def best_threshold(bins: np.ndarray, toxic: np.ndarray, other: np.ndarray) -> float:
    """The score from which on F1 is best, in the middle of the gap below; 0.5 where there is nothing to tell apart.
    bins, in order, and how much of either class is in each. Of equal F1 the highest score is taken."""
    if not toxic.sum() or not other.sum():
        return 0.5
    hits, others = toxic[::-1].cumsum(), other[::-1].cumsum()
    f1 = 2 * hits / (hits + others + toxic.sum())
    k = len(bins) - 1 - int(np.argmax(f1))
    below = bins[k - 1] + 1 if k else bins[k]
    return float(1 / (1 + np.exp(-(bins[k] + below) / 2 / STEPS)))


def thresholds(counts: list[tuple[str | None, int, int, bool, int]]) -> dict[str | None, float]:
    """Each language's threshold from (language, bin, toxic, fitted, count).

    Rows that the model was fitted on only tell how many each class has: the others stand for them, so that both
    classes keep their natural ratio. Each language's counts are added to those of all, scaled to PSEUDO toxic
    rows; so rare languages take after all of them, by degrees. None is the key of all."""
    data = [(x, b, int(y), f, n) for x, b, y, f, n in counts]
    whole, free = [0, 0], [0, 0]
    for _, _, y, fitted, n in data:
        whole[y] += n
        free[y] += 0 if fitted else n
    bins = np.array(sorted({b for _, b, _, f, _ in data if not f}), np.int64)
    if not min(free):
        return {None: 0.5}
    at = {b: k for k, b in enumerate(bins.tolist())}
    tables: dict[str | None, np.ndarray] = {None: np.zeros((2, len(bins)))}
    for x, b, y, fitted, n in data:
        if not fitted:
            for key in {None, x}:
                tables.setdefault(key, np.zeros((2, len(bins))))[y, at[b]] += n * whole[y] / free[y]
    prior = tables[None] * PSEUDO / tables[None][1].sum()
    return {x: best_threshold(bins, *(t if x is None else t + prior)[::-1]) for x, t in tables.items()}


def _labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("i")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> tuple[Classifier, DataFrame]:
    """(the classifier without thresholds, ids that it was fitted on).

    At most rows labelled texts of size bytes in all, those of the least id hashes in each class. Rows with a null
    label, id or text are left out; an id that is labelled twice counts as toxic if one label says so."""
    light = _labelled(labels, id_col, label_col).where(F.pmod(F.xxhash64("i", F.lit(SEED)), F.lit(HELD_OUT)) != 0)
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("i"), "i"))
    chosen = light.withColumn("r", rank).where(F.col("r") <= rows // 2).drop("r")
    texts = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    # the chosen ids are at most rows, so they may be broadcast
    found = texts.join(F.broadcast(chosen), F.col("d") == F.col("i"))
    before = F.sum(F.octet_length("t")).over(Window.partitionBy("y").orderBy(F.xxhash64("i"), "i", "t").rowsBetween(Window.unboundedPreceding, -1))
    table = found.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < size // 2).select("i", "t", "y").toArrow().sort_by([("i", "ascending"), ("t", "ascending")])
    text, y = table.column(1).to_pylist(), table.column(2).to_pylist()
    model = Classifier().fit(text, y)
    if len(set(y)) < 2:
        model.bias = np.float32(-20.0)
    ids = docs.sparkSession.createDataFrame([(x,) for x in set(table.column(0).to_pylist())], f"i {docs.schema[id_col].dataType.simpleString()}")
    return model, ids


def calibrate(scored: DataFrame, labels: DataFrame, fitted: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> dict[str | None, float]:
    """Thresholds by language, see thresholds(), from all labelled rows of scored (id, score, language)."""
    z = F.log(F.greatest("score", F.lit(1e-12)) / F.greatest(1 - F.col("score"), F.lit(1e-12)))
    step = F.floor(F.greatest(F.least(z, F.lit(float(SPAN))), F.lit(-float(SPAN))) * STEPS).cast("long")
    rows = scored.select(F.col(id_col).alias("d"), step.alias("b"), "language")
    known = rows.join(_labelled(labels, id_col, label_col), F.col("d") == F.col("i")).drop("i")
    # the fitted ids are at most TRAIN_ROWS
    seen = known.join(F.broadcast(fitted.select(F.col("i"), F.lit(True).alias("f"))), F.col("d") == F.col("i"), "left")
    counts = seen.groupBy("language", "b", "y", F.coalesce("f", F.lit(False)).alias("f")).count().collect()  # languages x steps
    return thresholds([tuple(r) for r in counts])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Classifier:
    """A classifier fitted on a bounded sample, see fit(), whose thresholds come from all other labelled rows.

    Without labels of both classes it calls nothing toxic. Labels of ids that docs doesn't have count nowhere."""
    model, fitted = fit(docs, labels, id_col, text_col, label_col, rows)
    known = docs.join(_labelled(labels, id_col, label_col).select(F.col("i").alias("i_of_label")), docs[id_col] == F.col("i_of_label"), "left_semi")
    model.thresholds = calibrate(scores(known, model, id_col, text_col, lang_col), labels, fitted, id_col, label_col)
    return model


def scores(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", language: Column | str = "lang") -> DataFrame:
    """(id, score, language, words) for each row: the probability, and whether there are words. See classify()."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is that of the hashed tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in pieces(batches, 1, 8_000_000):
            codes, counts, rows = hashed(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(codes, counts, rows)), b.column(2), pa.array(counts > 0)], [id_col, "score", "language", "words"])

    kind = docs.schema[id_col].dataType.simpleString()
    lang = F.col(language) if isinstance(language, str) else language
    return docs.select(F.col(id_col), F.col(text_col), lang.cast("string").alias("language_")).mapInArrow(run, f"`{id_col}` {kind}, score double, language string, words boolean")


def judged(scored: DataFrame, limits: dict[str | None, float], id_col: str = "doc_id") -> DataFrame:
    """(id, score, toxic) of scores(), by each language's threshold."""
    own = F.create_map(*[F.lit(x) for k, v in limits.items() if k is not None for x in (k, v)]) if len(limits) > 1 else None
    limit = F.lit(limits[None]) if own is None else F.coalesce(own[F.col("language")], F.lit(limits[None]))
    return scored.select(id_col, "score", ((F.col("score") >= limit) & F.col("words")).alias("toxic"))


def detect(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> DataFrame:
    """classify(docs, train(docs, labels)), with every row scored once."""
    model, fitted = fit(docs, labels, id_col, text_col, label_col)
    scored = written(scores(docs, model, id_col, text_col, lang_col))
    return judged(scored, calibrate(scored, labels, fitted, id_col, label_col), id_col)


def classify(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", language: Column | str = "lang") -> DataFrame:
    """(id, score, toxic) for each row: the probability, and whether it reaches the language's threshold.

    A text at its threshold is toxic. A null language, or one without a threshold of its own, has that of
    all. A null or empty text, or one without words, has score 0 and isn't toxic. Each row is judged by itself, so repeated rows and
    null ids stay; texts are read whole; an empty table gives an empty one, other columns are left out.
    """
    return judged(scores(docs, model, id_col, text_col, language), model.thresholds, id_col)
