"""python -m phasegrid COMMAND -f CONFIG"""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import SparkSession

from phasegrid.config import Config
from phasegrid.plans import workflow
from phasegrid.sources.headers import read_texts


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser("phasegrid", description="Displacement rates and time series from interferograms.")
    parser.add_argument("-v", "--verbosity", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    commands = parser.add_subparsers(dest="command", required=True)
    for name in (*workflow.COMMANDS, "workflow"):
        commands.add_parser(name).add_argument("-f", "--config_file", required=True)
    given = parser.parse_args(args)
    logging.basicConfig(level=given.verbosity, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName(f"phasegrid {given.command}").getOrCreate()
    began = time.time()
    config = Config.parse(read_texts(spark, [given.config_file])[given.config_file])
    (workflow.workflow if given.command == "workflow" else workflow.COMMANDS[given.command])(spark, config)
    logging.getLogger("phasegrid").info("%s took %.1f s", given.command, time.time() - began)


if __name__ == "__main__":
    main()
