"""Offline tools.

python -m sparkloom analyze CAPTURE | baseline CAPTURE OUT | compare BASELINE CAPTURE
    | workload-baseline CAPTURE OUT | workload-compare BASELINE CAPTURE | check DDL | audit FOLDER
    | migrate FOLDER RECORD status|up|down|baseline [VERSION] | lint FOLDER
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="sparkloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, *rest in (("analyze", "capture"), ("baseline", "capture", "out"), ("compare", "baseline", "capture"), ("workload-baseline", "capture", "out"), ("workload-compare", "baseline", "capture"), ("lint", "folder"), ("migrate", "folder", "record", "action"), ("check", "ddl"), ("audit", "folder")):
        sub = commands.add_parser(name)
        for r in rest:
            sub.add_argument(r, **({"choices": ("status", "up", "down", "baseline")} if r == "action" else {}))
        if name == "migrate":
            sub.add_argument("version", type=int, nargs="?")
    options = parser.parse_args(arguments)
    from .operators.demo import MODELS

    if options.command == "check":
        from .schema.checks import check_model, check_schema, report
        from .schema.ddl import parse

        catalog = parse(Path(options.ddl).read_text())
        left, failed = report([d for m in MODELS for d in (*check_model(m), *check_schema(m, catalog))])
        for d in left:
            print(d.code, d.severity, d.subject, d.message)
        return int(failed)
    if options.command == "lint":
        from .schema.migrate import lint, load

        warned = lint(load(options.folder))
        for d in warned:
            print(d.code, d.severity, d.subject, d.message)
        return int(any(d.severity == "error" for d in warned))
    if options.command == "migrate" and options.action == "baseline" and options.version is None:
        parser.error("baseline needs a version")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("sparkloom").getOrCreate()
    from .plans import capture as c

    if options.command == "migrate":
        from .schema.migrate import Runner

        runner = Runner(spark, options.folder, options.record)
        if options.action == "status":
            for row in runner.status():
                print(*row)
            return 0
        done = runner.up(options.version) if options.action == "up" else runner.down() if options.action == "down" else runner.baseline(options.version)
        print(*done)
        return 0
    if options.command == "audit":
        from .plans.registry import source
        from .schema.audit import audit

        found = audit([m for m in MODELS], source(spark, options.folder))
        for d in found:
            print(d.code, d.severity, d.subject, d.message)
        return int(any(d.severity == "error" for d in found))
    if options.command == "baseline":
        c.cost_baseline(c.read_capture(spark, options.capture)).write.parquet(options.out)
        return 0
    if options.command == "workload-baseline":
        c.workload_baseline(c.read_capture(spark, options.capture)).write.parquet(options.out)
        return 0
    if options.command == "workload-compare":
        found = c.compare_workloads(spark.read.parquet(options.baseline), c.read_capture(spark, options.capture))
    elif options.command == "analyze":
        found = c.analyze(c.read_capture(spark, options.capture)).orderBy("code", "scope", "fingerprint")
    else:
        found = c.compare_costs(spark.read.parquet(options.baseline), c.read_capture(spark, options.capture))
    rows = found.collect()
    for r in rows:
        print(*r)
    return int(bool(rows))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
