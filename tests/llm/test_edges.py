"""Every operator and every stage over the awkward table, an empty one, and one of nulls."""

import pytest
from pyspark.sql import functions as F

from siltmill.llm import fingerprints, grammar, language, near_dedup, packing, pieces, quality, token_counts, toxicity, url_filter

from . import edges


def _model():
    return toxicity.Classifier().fit(["you scum idiot", "fine day", "scum here", "a day"] * 5, [1, 0, 1, 0] * 5, epochs=2)


OPS = {
    "pack": lambda d: packing.pack(d, 50),
    "simhash": lambda d: fingerprints.near_documents(d),
    "forest": lambda d: near_dedup.groups(d),
    "keep_one": lambda d: near_dedup.keep_one(d),
    "identify": lambda d: language.identify(d, declared=F.col("lang"), host=F.col("source")),
    "keep_known": lambda d: language.keep_known(d, declared=F.col("lang"), host=F.col("source")),
    "shards": lambda d: grammar.read_shards(grammar.write_shards(d)),
    "encode": lambda d: pieces.encode(d, decoded=True),
    "quality": lambda d: quality.rate(d),
    "keep_good": lambda d: quality.keep_good(d),
    "toxicity": lambda d: toxicity.classify(d, _model()),
    "urls": lambda d: url_filter.filter_urls(d, id_col="doc_id", url_col="text"),
    "counts": lambda d: token_counts.count_tokens(d),
}


@pytest.mark.parametrize("name", OPS)
def test_edges(spark, name):
    OPS[name](edges.table(spark)).collect()


@pytest.mark.parametrize("name", OPS)
def test_empty(spark, name):
    assert OPS[name](edges.empty(spark)).collect() == []


@pytest.mark.parametrize("name", OPS)
def test_nulls_only(spark, name):
    OPS[name](edges.table(spark, [(None, None), (1, None), (1, None)])).collect()


@pytest.mark.parametrize("name", ["keep_one", "keep_known", "keep_good"])
def test_filters_keep_columns(spark, name):
    d = edges.table(spark)
    assert OPS[name](d).columns == d.columns


@pytest.mark.parametrize("name", ["encode", "quality", "toxicity", "urls", "counts", "identify"])
def test_a_row_for_each_row(spark, name):
    assert OPS[name](edges.table(spark)).count() == len(edges.TEXTS)
