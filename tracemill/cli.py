"""Command line: ``python -m tracemill.cli summary DOCUMENT`` and ``run DOCUMENT [--section NAME]``; JSON with sorted keys on standard output."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from tracemill.plans import flow


def shown(value: Any, pretty: bool) -> str:
    return json.dumps(value, sort_keys=True, indent=2 if pretty else None, separators=None if pretty else (",", ":"))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracemill", description=__doc__)
    p.add_argument("--pretty", action="store_true")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("summary").add_argument("document")
    run = commands.add_parser("run")
    run.add_argument("document")
    run.add_argument("--section", choices=("all", "artifacts", "results", "checks"), default="all")
    o = p.parse_args(args)
    try:
        document = flow.load_document(o.document)
        if o.command == "summary":
            flow.check_document(document)
            out: Any = {k: document.get(k) for k in ("kind", "schema", "covers")} | {"steps": [x["step"] for x in document["steps"]]}
        else:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
            out = flow.Flow(spark, document).run()
            if o.section != "all":
                out = out[o.section]
    except (OSError, ValueError, KeyError, TypeError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    print(shown(out, o.pretty))
    return 0


if __name__ == "__main__":
    sys.exit(main())
