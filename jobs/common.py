"""What the jobs share: their config files and their command lines."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def config_of(path: str, known: dict) -> dict:
    """The settings of a small local JSON file on top of known ones; a setting that isn't known is an error."""
    with open(path) as f:
        found = json.load(f)
    unknown = set(found) - set(known)
    if unknown:
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return known | found


def main(name: str, job: Callable, paths: dict[str, str], known: dict, argv: list[str] | None = None) -> None:
    """The command line of job: --config and a path for each of paths. Creates the session and stops it."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=job.__doc__)
    parser.add_argument("--config", default=os.path.join(ROOT, "jobs", f"{name}.json"), help="settings (JSON)")
    for p, says in paths.items():
        parser.add_argument(f"--{p}", required=True, help=says)
    args = vars(parser.parse_args(sys.argv[1:] if argv is None else argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = config_of(args.pop("config"), known)
    os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])  # for Python workers of a local master
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        job(spark, **args, config=config)
    finally:
        spark.stop()
