"""Create or reset the stored collection: ``python -m docloom PATH [--reset [--force]]``."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable, Sequence

from docloom import config, log


def main(argv: Sequence[str] | None = None, ask: Callable[[str], str] = input) -> int:
    from pyspark.sql import SparkSession

    from docloom.sources import store

    parser = argparse.ArgumentParser(prog="docloom", description="Manage the stored collection.")
    parser.add_argument("path", help="folder of the collection")
    parser.add_argument("--reset", action="store_true", help="replace it by an empty one; all rows are lost")
    parser.add_argument("--force", action="store_true", help="reset without asking")
    parser.add_argument("--encoder", default="", help="name of the encoder the vectors come from")
    parser.add_argument("--width", type=int, default=0, help="width of its vectors")
    args = parser.parse_args(argv)
    log.setup(config.load())
    spark = SparkSession.builder.getOrCreate()
    told = logging.getLogger("docloom")
    if args.reset:
        if not args.force and ask(f"Everything in {args.path} will be lost. Type the path to confirm: ").strip() != args.path:
            told.info("collection unchanged")
            return 1
        store.reset(spark, args.path)
        told.info("collection at %s reset", args.path)
    elif store.ensure(spark, args.path):
        told.info("collection at %s created", args.path)
    else:
        told.info("collection at %s exists", args.path)
    if args.encoder:
        store.hold_encoder(spark, args.path, args.encoder, args.width)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
