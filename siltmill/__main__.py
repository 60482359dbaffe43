"""python -m siltmill CONFIG.toml [--strict]: run the deduplication that the file describes."""

import sys

from pyspark.sql import SparkSession

from siltmill.config import load_config
from siltmill.plans.pipelines import run
from siltmill.session import use_repo


def main(args: list[str]) -> int:
    paths = [a for a in args if not a.startswith("--")]
    if len(paths) != 1:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("siltmill").getOrCreate()
    use_repo(spark)
    run(spark, load_config(paths[0]), strict="--strict" in args)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
