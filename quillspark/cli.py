"""``python -m quillspark.cli --input records.csv --results-dir out [--skip a3,a5]``"""

from __future__ import annotations

import argparse
import sys
import time
import traceback

from pyspark.sql import DataFrame

from quillspark.operators import classify
from quillspark.plans import corpus, modules
from quillspark.session import get_session
from quillspark.sources import named, records, sinks


def parse(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--input", required=True)
    parser.add_argument("--results-dir", required=True)
    parser.add_argument("--skip", default="", help=f"modules to skip, separated by commas: {', '.join(modules.MODULES)}")
    options = parser.parse_args(args)
    options.skip = {s.strip().lower() for s in options.skip.split(",") if s.strip()}
    if unknown := options.skip - modules.MODULES.keys():
        parser.error(f"unknown modules to skip: {', '.join(sorted(unknown))}")
    return options


def write(tables: dict[str, modules.Table], folder: str) -> None:
    for name, table in tables.items():
        rows = table.rows.orderBy(*table.order) if table.order else table.rows
        named.write_named(rows, f"{folder}/{name}.csv")
        if table.markdown:
            sinks.write_text(rows.sparkSession, sinks.markdown(rows), f"{folder}/{name}.md")


def stage_report(audit: DataFrame) -> str:
    """The audit as text: a line for each stage with its records, what it removed and what it keeps."""
    lines = []
    for r in audit.orderBy("stage_no").collect():  # a row for each stage
        removed = f"  ({r['removed']:,} dropped)" if r["removed"] else ""
        lines += [f"  {r['stage']:>34}  {r['records']:>9,} records{removed}", f"  {'':>34}  {corpus.CRITERIA[r['stage']]}"]
    return "\n".join(lines)


def class_report(df: DataFrame) -> str:
    """The report on the classes as text, a line for each."""
    lines, section = [], None
    for r in classify.class_report(df).orderBy("place").collect():  # ten rows
        lines += [f"  {r['section']}"] if r["section"] != section else []
        section = r["section"]
        lines.append(f"    {r['label']:<30}: {r['records']:>9,} ({r['percent']}%)")
    return "\n".join(lines)


def main(args: list[str] | None = None) -> None:
    """Runs all stages and modules; a failed module leaves the others' results and ends in exit code 1."""
    began = time.time()
    options = parse(args)
    spark = get_session()
    folder = options.results_dir
    raw = records.canonical_columns(records.read_records(spark, options.input))
    audit = corpus.audited(raw, f"{folder}/screened_corpus")
    judged = spark.read.parquet(f"{folder}/screened_corpus")
    included = judged.filter("Education_Screen_Disposition = 'include_algorithm'")
    print(stage_report(audit), class_report(included), sep="\n")
    write(modules.a11(judged), folder)
    sinks.write_text(spark, modules.methods_text(judged), f"{folder}/education_screen_methods.md")
    write(modules.a10(included), folder)
    sinks.write_corpus(included.filter("Tech_Category is not null"), f"{folder}/classified_corpus")
    write(modules.a0(audit), folder)
    kept = modules.prepared(spark.read.parquet(f"{folder}/classified_corpus"))
    failed = []
    for name, module in modules.MODULES.items():
        if name in options.skip:
            continue
        try:
            write(module(kept), folder)
        except Exception as error:  # noqa: BLE001
            traceback.print_exc()
            failed.append(f"{name}: {error}")
    print(f"{time.time() - began:.1f} s", *failed, sep="\n")
    if failed:
        sys.exit(1)


if __name__ == "__main__":
    main()
