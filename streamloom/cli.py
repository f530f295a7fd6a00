"""Command line: annotate a table of frame cells, or show a composed configuration."""

from __future__ import annotations

import argparse
import json

from .config import compose, primitive


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="streamloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("infer", "config"):
        c = sub.add_parser(name)
        c.add_argument("--preset", default="default")
        c.add_argument("overrides", nargs="*", help="settings as a.b=value")
        if name == "infer":
            c.add_argument("--cells", required=True, help="Parquet of stream_id, frame_idx, v, u, value")
            c.add_argument("--height", type=int, required=True)
            c.add_argument("--width", type=int, required=True)
    a = p.parse_args(argv)
    config = compose(a.preset, a.overrides)
    if a.command == "config":
        print(json.dumps(primitive(config), indent=2))
        return 0
    from pyspark.sql import SparkSession

    from .plans import pipelines

    spark = SparkSession.builder.getOrCreate()
    cells = pipelines.make(config)(spark.read.parquet(a.cells), config, a.height, a.width)
    pipelines.save(cells, config.output.path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
