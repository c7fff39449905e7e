"""python -m plumbline query|explain|schema|bench|version --table NAME=PATHS ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.errors import AnalysisException, ParseException, PySparkException

from plumbline.dialect import DialectError
from plumbline.engine import Engine
from plumbline.session import build_session
from plumbline.sources import sinks

VERSION = "0.1.0"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="plumbline")
    parser.add_argument("command", choices=["query", "explain", "schema", "bench", "version"])
    parser.add_argument("-c", "--sql")
    parser.add_argument("--table", action="append", default=[], metavar="NAME=PATH[,PATH]")
    parser.add_argument("--type", action="append", default=[], metavar="COLUMN=DATE")
    parser.add_argument("--format", choices=[*sinks.FORMATS], default="table")
    parser.add_argument("--mode", default="formatted", choices=["simple", "extended", "formatted", "cost", "codegen", "analyze"])
    parser.add_argument("--queries", help="a file with a query on each line")
    parser.add_argument("--tries", type=int, default=3)
    parser.add_argument("--master")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    engine = Engine(build_session(master=args.master, spark__ui__enabled="false"))
    dates = tuple(t.split("=")[0] for t in args.type if t.upper().endswith("=DATE"))
    try:
        for t in args.table:
            name, _, paths = t.partition("=")
            engine.register(name, paths, tuple(d for d in dates))
        if args.command == "schema":
            for t in args.table:
                for name, kind in engine.schema(t.partition("=")[0]):
                    print(name, kind)
        elif args.command == "explain":
            print(engine.explain(args.sql, args.mode))
        elif args.command == "bench":
            queries = [q for q in Path(args.queries).read_text().splitlines() if q.strip()]
            print(json.dumps({"result": engine.bench(queries, args.tries)}))
        else:
            sinks.print_result(engine.sql(args.sql), args.format, sys.stdout)
    except (DialectError, ParseException, AnalysisException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 4
    except (OSError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
