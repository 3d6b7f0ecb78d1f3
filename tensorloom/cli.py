"""Command line: ``python -m tensorloom convert|revert|metadata``."""

from __future__ import annotations

import argparse
import json
import sys
import traceback


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tensorloom", description="Pack, unpack and inspect tensor containers.")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="tensor file or table to container")
    c.add_argument("source")
    c.add_argument("destination", nargs="?")
    c.add_argument("--dtype", "-d", help="one type for all tensors")
    c.add_argument("--align-bytes", type=int, default=128)
    for kind in ("names", "prefixes", "suffixes"):
        c.add_argument(f"--ignore-{kind}", "-" + {"names": "i", "prefixes": "p", "suffixes": "s"}[kind], action="append", default=[])
    r = sub.add_parser("revert", help="container to safetensors file or Parquet table")
    r.add_argument("source")
    r.add_argument("destination", nargs="?")
    m = sub.add_parser("metadata", help="what a container holds")
    m.add_argument("source")
    m.add_argument("--show-index", "-i", action="store_true")
    m.add_argument("--json", "-j", action="store_true")
    for x in (c, r, m):
        x.add_argument("--magic", help="another writer's magic, seven or eight characters")
        x.add_argument("--prefix", help="another writer's format prefix")
        x.add_argument("--verbose", "-v", action="store_true")
    return p


def metadata(args) -> str:
    """A footer as text or JSON; needs no session."""
    from tensorloom.sources import container
    from tensorloom.sources.datasource import signature

    f = container.read_footer(args.source, signature(vars(args)))
    meta = dict(f.raw) if args.show_index else {k: v for k, v in f.raw.items() if k != "index"}
    if args.json:
        return json.dumps(meta, indent=2, ensure_ascii=False)
    lines = [f"{k}: {v}" for k, v in meta.items() if k not in ("index", "macroblocks")]
    digits = len(str(f.total_payload_bytes))
    lines.append("macroblocks:")
    for i, b in enumerate(sorted(f.blocks, key=lambda b: b.offset_bytes)):
        lines.append(f"  {i}: {b.dtype:<10} {b.offset_bytes:0{digits}d}:{b.offset_bytes + b.length_bytes:0{digits}d}")
    if args.show_index:
        lines.append("index:")
        width, most = len(str(len(f.index))), len(str(max((e.offset + e.length for e in f.index), default=0)))
        last = None
        for i, e in enumerate(sorted(f.index, key=lambda e: (e.macroblock, e.offset))):
            if e.macroblock != last:
                b = f.blocks[e.macroblock]
                lines.append(f"  macroblock{e.macroblock}: {b.dtype:<10} {0:0{most}d}:{b.length_elems:0{most}d}")
                last = e.macroblock
            lines.append(f"  {i:0{width}d}: {e.offset:0{most}d}:{e.offset + e.length:0{most}d} {e.name} {list(e.shape)}")
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    """0 if all went well; errors go to the error stream, with their trace if asked for."""
    args = parser().parse_args(argv)
    try:
        if args.command == "metadata":
            print(metadata(args))
            return 0
        from pyspark.sql import SparkSession

        from tensorloom import api
        from tensorloom.sources.datasource import signature

        spark = SparkSession.builder.appName("tensorloom").getOrCreate()
        if args.command == "convert":
            ignore = {f"ignore_{k}": getattr(args, f"ignore_{k}") for k in ("names", "prefixes", "suffixes")}
            made = api.convert(spark, args.source, args.destination, args.dtype, align_bytes=args.align_bytes, signature=signature(vars(args)), **ignore)
        else:
            given = {k: v for k, v in (("magic", args.magic), ("prefix", args.prefix)) if v}
            made = api.revert(spark, args.source, args.destination, **given)
        print(made)
        return 0
    except Exception as e:  # noqa: BLE001
        print(traceback.format_exc() if args.verbose else f"Error: {e}", file=sys.stderr)
        return 1
