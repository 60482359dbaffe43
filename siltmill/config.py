"""Settings of a run, read from TOML: [input], [algorithm], [output]."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from typing import Any

from siltmill.operators.minhash import MinHash
from siltmill.operators.simhash import SimHash

ALGORITHMS = ("minhash", "simhash", "bloom_filter", "suffix_array")


@dataclass(frozen=True)
class Input:
    """Where the corpus is. file_type: parquet, csv, json or any other format that Spark reads."""

    path: str
    file_type: str = "parquet"
    split: str | None = None
    order: tuple[str, ...] | None = None
    options: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Exact:
    """Exact duplicates. max_elements and error_rate are read for configurations of approximate filters,
    and have no effect, as the comparison is exact."""

    text_column: str = "text"
    max_elements: int | None = None
    error_rate: float | None = None
    index_column: str = "__INDEX__"
    cluster_column: str = "__CLUSTER__"


@dataclass(frozen=True)
class Substring:
    text_column: str = "text"
    length_threshold: int = 100
    merge_strategy: str = "longest"
    index_column: str = "__INDEX__"
    cluster_column: str = "__CLUSTER__"


@dataclass(frozen=True)
class Output:
    output_dir: str
    skip_filtering: bool = False
    clean_cache: bool = False
    save_clusters: bool = False
    keep_index_column: bool = False
    keep_cluster_column: bool = False


@dataclass(frozen=True)
class Config:
    input: Input
    algorithm: Any
    output: Output
    name: str
    verify: bool = False


def _make(kind: type, given: dict[str, Any], where: str) -> Any:
    known = {f.name for f in fields(kind)}
    if unknown := set(given) - known:
        raise ValueError(f"{where}: unknown settings {', '.join(sorted(unknown))}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


_KINDS = {"minhash": MinHash, "simhash": SimHash, "bloom_filter": Exact, "suffix_array": Substring}
#: Settings that other engines need and Spark's own configuration has.
_IGNORED = ("num_proc", "batch_size", "signature_column", "google_repo_path", "cache_dir")


def load_config(path: str) -> Config:
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    for part in ("input", "algorithm", "output"):
        if part not in raw:
            raise ValueError(f"{path}: [{part}] is missing")
    algorithm = {k: v for k, v in raw["algorithm"].items() if k not in _IGNORED}
    name = algorithm.pop("algorithm_name", None)
    if name not in _KINDS:
        raise ValueError(f"algorithm_name is one of {', '.join(ALGORITHMS)}, not {name}")
    verify = algorithm.pop("check_false_positive", False)
    if "text_column" not in algorithm:
        raise ValueError("text_column is missing")
    source = dict(raw["input"])
    kind, given = source.pop("input_type", "local_files"), source.pop("read_arguments", {})
    if kind not in ("local_files", "local_dataset"):
        raise ValueError(f"input_type is local_files or local_dataset, not {kind}")
    # arguments that name the place, the kind and the part; the rest are options of the reader
    for key, mine in (("path", "path"), ("data_files", "path"), ("dataset_path", "path"), ("file_type", "file_type"), ("split", "split")):
        if key in given:
            source.setdefault(mine, given.pop(key))
    drop = ("num_proc", "streaming", "cache_dir", "keep_in_memory", "token", "name", "trust_remote_code")
    source["options"] = {**{k: str(v) for k, v in given.items() if k not in drop}, **source.get("options", {})}
    return Config(_make(Input, source, "input"), _make(_KINDS[name], algorithm, "algorithm"), _make(Output, raw["output"], "output"), name, verify)
