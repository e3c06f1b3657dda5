"""Command line: put, get, del, scan, stats, compact, gc on a store directory.

Exit codes: 0 done, 1 not found, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from keystrata.plans.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="keystrata")
    p.add_argument("store")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb, args in {"put": ["key", "value"], "get": ["key"], "del": ["key"], "scan": ["start", "end"], "stats": [], "compact": [], "gc": []}.items():
        sub = verbs.add_parser(verb)
        for a in args:
            sub.add_argument(a)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("keystrata").getOrCreate()
    store = Store(spark, args.store, read_only=args.verb in ("get", "scan", "stats"))
    try:
        if args.verb == "put":
            store.put(args.key.encode(), args.value.encode())
            print("OK")
        elif args.verb == "del":
            store.delete(args.key.encode())
            print("OK")
        elif args.verb == "get":
            value = store.get(args.key.encode())
            if value is None:
                print("(not found)", file=sys.stderr)
                return 1
            print(value.decode("utf-8", "replace"))
        elif args.verb == "scan":
            for row in store.scan(args.start.encode(), args.end.encode()).toLocalIterator():
                print(f"{bytes(row['key']).decode('utf-8', 'replace')}\t{bytes(row['value']).decode('utf-8', 'replace')}")
        elif args.verb == "stats":
            print(store.stats_json())
        elif args.verb == "compact":
            store.compact_all()
            print("OK")
        else:
            store.collect_values()
            print("OK")
    finally:
        store.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
