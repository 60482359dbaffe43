"""The four deduplication runs, from a corpus to a saved one."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmill.config import Config
from siltmill.operators import exact, minhash, simhash, substring
from siltmill.session import discard_all, written
from siltmill.sources import io


class Timer:
    """Seconds by stage."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def __call__(self, name: str):
        began = time.perf_counter()
        yield
        self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def report(self, **counts: float) -> str:
        whole = sum(self.seconds.values()) or 1.0
        lines = [f"{k}: {v:.2f}s ({100 * v / whole:.1f} %)" for k, v in self.seconds.items()]
        return "\n".join([*lines, f"total: {whole:.2f}s", *(f"{k}: {v}" for k, v in counts.items())])


def run_minhash(docs: DataFrame, c: minhash.MinHash, verify: bool = False, filtering: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, mapping). Rows of too few words are gone in either case."""
    docs = minhash.long_enough(docs, c)
    found = written(minhash.clusters(docs, c))
    flagged = minhash.assign(docs, found, c)
    if verify:
        found = written(minhash.verified(docs, found, c))
        flagged = minhash.assign(flagged.drop(c.cluster_column), found, c, flag=None)
    return (minhash.remove(flagged, c) if filtering else flagged), found


def run_simhash(docs: DataFrame, c: simhash.SimHash, verify: bool = False, filtering: bool = True, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, mapping). strict: roots by replayed unions, verification without roots, and rows removed by
    the flags from before the verification; else the least id is the root, takes part, and flags follow."""
    found = written(simhash.clusters(docs, c, "replay" if strict else "least"))
    flagged = simhash.assign(docs, found, c)
    if verify:
        found = written(simhash.verified(docs, found, c, with_root=not strict))
        fresh = simhash.assign(docs, found, c)
        if strict:
            stale = flagged.select(c.index_column, F.col("__duplicate__").alias("stale"))
            fresh = fresh.drop("__duplicate__").join(stale, c.index_column).withColumnRenamed("stale", "__duplicate__")
        flagged = fresh
    return (simhash.remove(flagged) if filtering else flagged), found


def _measure(docs: DataFrame, text: str, sized: bool) -> list[int]:
    """Rows, and the texts' bytes where they are asked for."""
    size = [F.coalesce(F.sum(F.octet_length(text)), F.lit(0))] if sized else []
    return list(docs.agg(F.count("*"), *size).first())


def run(spark: SparkSession, config: Config, strict: bool = False) -> dict[str, float]:
    """Load, deduplicate, save; what was counted and how long stages took."""
    timer, c, out = Timer(), config.algorithm, config.output
    with timer("load"):
        docs = io.load(spark, config.input.path, config.input.file_type, config.input.split, list(config.input.order) if config.input.order else None, c.index_column, **config.input.options)
        sized = ["bytes_before", "bytes_after"] if config.name == "suffix_array" else []
        before, *bytes_before = _measure(docs, c.text_column, bool(sized))
    found = None
    with timer(config.name):
        if config.name == "minhash":
            rows, found = run_minhash(docs, c, config.verify, not out.skip_filtering)
        elif config.name == "simhash":
            rows, found = run_simhash(docs, c, config.verify, not out.skip_filtering, strict)
        elif config.name == "bloom_filter":
            rows = exact.flag_copies(docs, c.text_column, c.index_column)
            rows = rows if out.skip_filtering else rows.where("NOT duplicate")
        else:
            rows = substring.remove_repeats(docs, c.length_threshold, c.text_column, c.index_column)
    with timer("save"):
        io.save(rows, out.output_dir, found, c.index_column, c.cluster_column, keep_index=out.keep_index_column, keep_cluster=out.keep_cluster_column, save_clusters=out.save_clusters)
        after, *bytes_after = _measure(spark.read.parquet(f"{out.output_dir}/data"), c.text_column, bool(sized))
    if out.clean_cache:
        discard_all()
    counts = {"before": before, "after": after, **dict(zip(sized, bytes_before + bytes_after))}
    print(timer.report(**counts))
    return {**counts, **timer.seconds}
