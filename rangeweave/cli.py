"""Command line: compress and decompress files or folders."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from rangeweave import batch
from rangeweave.params import CodecParams


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rangeweave", description=__doc__)
    sub = top.add_subparsers(dest="command")
    c = sub.add_parser("compress", help="encode WAV files")
    c.add_argument("input")
    c.add_argument("output", nargs="?")
    c.add_argument("--tile", type=int, default=1024)
    c.add_argument("--energy-thresh", type=float, default=1e-4)
    d = sub.add_parser("decompress", help="decode containers")
    d.add_argument("input")
    d.add_argument("--iter", type=int, default=8)
    d.add_argument("--eps", type=float, default=1e-3)
    for p in (c, d):
        p.add_argument("--out", help="folder of the results")
        p.add_argument("--batch", action="store_true", help="input is a folder")
        p.add_argument("--workers", type=int, default=4, help="local threads, where no cluster is set")
        p.add_argument("--gpu", action="store_true", help="accepted and ignored")
    return top


def main(args: list[str] | None = None) -> int:
    top = parser()
    a = top.parse_args(args)
    if a.command is None:
        top.print_help()
        return 0
    if a.command == "compress" and bool(a.output) == a.batch:
        top.error("compress needs an output, or --batch and no output")
    single = a.output if a.command == "compress" else None  # the file that a single input becomes
    folder = a.out or (os.path.dirname(single) or "." if single else a.input if a.batch else os.path.dirname(a.input) or ".")
    builder = SparkSession.builder.appName("rangeweave")
    if "SPARK_MASTER" not in os.environ and SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{a.workers}]")
    spark = builder.getOrCreate()
    if a.command == "compress":
        done = batch.compress(spark, a.input, folder, CodecParams(tile=a.tile, energy_threshold=a.energy_thresh), skip=a.batch, output=os.path.basename(single) if single else None)
    else:
        done = batch.decompress(spark, a.input, folder, CodecParams(iterations=a.iter, eps=a.eps))
    if a.batch:
        name = "compression_metrics.json" if a.command == "compress" else "decompression_metrics.json"
        batch.save_metrics(done, os.path.join(folder, name))
    failed = [r for r in done.collect() if r["error"]]
    for r in failed:
        print(f"{r['input']}: {r['error']}", file=sys.stderr)
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
