"""Command line: ``python -m gridloom.cli graph|plan|plot ...``."""

from __future__ import annotations

import argparse
import math

from pyspark.sql import SparkSession

from gridloom.engine import Engine
from gridloom.errors import QueryError
from gridloom.lang.parser import parse, render
from gridloom.sources.wide import WideParquetSource, parquet_time_range

SECOND = 1_000_000_000


def _engine(path: str) -> Engine:
    spark = SparkSession.builder.appName("gridloom").config("spark.ui.enabled", "false").getOrCreate()
    return Engine(WideParquetSource(spark, path))


def _frame(args: argparse.Namespace, ranged: bool):
    engine, footer = _engine(args.file), parquet_time_range(args.file)
    if args.start is not None or args.end is not None or (ranged and args.time is None):
        start = footer.start_ns if args.start is None else int(args.start * SECOND)
        end = footer.end_ns if args.end is None else int(args.end * SECOND)
        return engine.range_frame(args.query, start, end, int(args.step * SECOND))
    return engine.instant_frame(args.query, footer.end_ns if args.time is None else int(args.time * SECOND))


def chart(series: list[tuple[str, list[tuple[int, float]]]], width: int = 72, height: int = 16) -> str:
    """A text chart of series of (time, value); values that are not finite are left out."""
    marks = "*o+x#@%&"
    points = [(t, v) for _, s in series for t, v in s if math.isfinite(v)]
    if not points:
        return "no data"
    (t0, t1), (v0, v1) = ((min(p[k] for p in points), max(p[k] for p in points)) for k in (0, 1))
    canvas = [[" "] * width for _ in range(height)]
    for n, (_, s) in enumerate(series):
        for t, v in s:
            if math.isfinite(v):
                x = round((t - t0) / ((t1 - t0) or 1) * (width - 1))
                y = round((v - v0) / ((v1 - v0) or 1) * (height - 1))
                canvas[height - 1 - y][x] = marks[n % len(marks)]
    lines = [f"{v1:>12.6g} |{''.join(canvas[0])}", *[f"{'':>12} |{''.join(row)}" for row in canvas[1:-1]], f"{v0:>12.6g} |{''.join(canvas[-1])}"]
    return "\n".join([*lines, *[f"  {marks[n % len(marks)]} {name}" for n, (name, _) in enumerate(series)]])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridloom")
    commands = parser.add_subparsers(dest="command", required=True)
    graph = commands.add_parser("graph", help="print the syntax tree")
    graph.add_argument("query")
    for name, step in (("plan", 1.0), ("plot", 15.0)):
        sub = commands.add_parser(name)
        sub.add_argument("-f", "--file", required=True)
        sub.add_argument("query")
        sub.add_argument("-t", "--time", type=float)
        sub.add_argument("--start", type=float)
        sub.add_argument("--end", type=float)
        sub.add_argument("--step", type=float, default=step)
        if name == "plan":
            for stage in ("logical", "optimized", "physical"):
                sub.add_argument(f"--{stage}", action="store_true")
    args = parser.parse_args(argv)
    try:
        if args.command == "graph":
            print(render(parse(args.query)))
        elif args.command == "plan":
            execution = _frame(args, ranged=False).df._jdf.queryExecution()
            every = not (args.logical or args.optimized or args.physical)
            for stage, plan in (("logical", execution.analyzed), ("optimized", execution.optimizedPlan), ("physical", execution.executedPlan)):
                if every or getattr(args, stage):
                    print(f"== {stage}\n{plan().toString()}")
        else:
            frame = _frame(args, ranged=True)
            series: dict[str, list[tuple[int, float]]] = {}
            for r in frame.df.orderBy("timestamp").toLocalIterator():
                name = ", ".join(f"{x}={r[x]}" for x in frame.labels if r[x])
                series.setdefault(name or "value", []).append((r["timestamp"], r["value"]))
            print(chart(sorted(series.items())))
    except QueryError as e:
        print(e)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
