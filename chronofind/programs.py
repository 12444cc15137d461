"""Programs: python -m chronofind.programs {ingest,rollup,vacuum,query} SETTINGS... [--once] [--request FILE]

Settings are TOML files (see config). ingest polls input_path/namespace and merges into store_path; rollup
merges rollup_size old segments of each shard into rollup_path, or in place where that is empty; vacuum
deletes what was replaced; query answers one request with lines of JSON.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from chronofind.config import EngineConfig
from chronofind.errors import EngineError
from chronofind.metrics import LogReporter, Reporter, StreamReporter
from chronofind.serving import answer
from chronofind.session import ship
from chronofind.sources.store import SegmentStore
from chronofind.streaming import ingest


def store_of(spark: SparkSession, config: EngineConfig, reporter: Reporter | None = None) -> SegmentStore:
    if not config.store_path:
        raise EngineError("store_path isn't set")
    return SegmentStore(spark, f"{config.store_path}/{config.namespace}", reporter)


def run_ingest(spark: SparkSession, config: EngineConfig, once: bool, reporter: Reporter) -> None:
    if not config.input_path:
        raise EngineError("input_path isn't set")
    spark.streams.addListener(StreamReporter(reporter))
    store = store_of(spark, config, reporter)
    ingest.start(spark, ingest.object_stream(spark, config), store, config, f"{store.root}/_checkpoint", reporter, once).awaitTermination()


def run_rollup(spark: SparkSession, config: EngineConfig, once: bool, reporter: Reporter, now: int | None = None) -> int:
    """Roll up until no shard has enough segments, then sleep or, with once, give the number of rounds."""
    store, rounds = store_of(spark, config, reporter), 0
    target = SegmentStore(spark, f"{config.rollup_path}/{config.namespace}", reporter) if config.rollup_path else None
    while True:
        while store.rollup(config.rollup_size, int(time.time()) if now is None else now, target, config.rollup_start_epoch, retire=target is None) is not None:
            rounds += 1
        if once:
            return rounds
        time.sleep(config.polling_interval)


def run_query(spark: SparkSession, config: EngineConfig, text: str, reporter: Reporter) -> None:
    for message in answer(store_of(spark, config), text, config, reporter):
        print(json.dumps({"rows": [row.asDict() for row in message.rows], "dictionary": message.dictionary}))


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chronofind", description=__doc__.split("\n")[0])
    parser.add_argument("program", choices=("ingest", "rollup", "vacuum", "query"))
    parser.add_argument("settings", nargs="+")
    parser.add_argument("--once", action="store_true", help="do what there is to do, then stop")
    parser.add_argument("--request", help="file with the request of query; default: standard input")
    given = parser.parse_args(arguments)
    config, reporter = EngineConfig.load(*given.settings), LogReporter()
    spark = SparkSession.builder.appName(f"chronofind-{given.program}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    if given.program == "ingest":
        run_ingest(spark, config, given.once, reporter)
    elif given.program == "rollup":
        run_rollup(spark, config, given.once, reporter)
    elif given.program == "vacuum":
        store_of(spark, config).vacuum()
    else:
        run_query(spark, config, Path(given.request).read_text() if given.request else sys.stdin.read(), reporter)
    return 0


if __name__ == "__main__":
    sys.exit(main())
