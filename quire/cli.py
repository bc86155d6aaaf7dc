"""python -m quire.cli [--text | --json | --layout] FILE: a report on one PDF file.

Exit codes: 0 done, 1 the file could not be read in full, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None, out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    ap = argparse.ArgumentParser(prog="quire", add_help=True)
    ap.add_argument("--text", action="store_true")
    ap.add_argument("--json", action="store_true")
    ap.add_argument("--layout", action="store_true")
    ap.add_argument("file")
    try:
        args = ap.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    if args.json and (args.text or args.layout):
        print("quire: --json excludes --text and --layout", file=err)
        return 2
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession

    from .operators.elements import Parsed, layout_text
    from .options import ALL, FULL, TEXT
    from .sources.reader import parse_files

    spark = SparkSession.builder.getOrCreate()
    try:
        found = Parsed(parse_files(spark, args.file, TEXT if args.layout else ALL, FULL)).persist()
    except AnalysisException as e:
        print(f"quire: {e.getMessage()}", file=err)
        return 1
    try:
        error = found.errors().first()
        if error or found.rows.isEmpty():
            print(f"quire: {error['message'] if error else 'no PDF file there'}", file=err)
            return 1
        n = found.diagnostics().count()
        if args.layout:
            row = layout_text(found.layout()).first()
            print(row.text if row else "", file=out)
        elif args.text:
            row = found.plain_text().first()
            print(row.text if row else "", end="", file=out)
            if n:
                print(f"quire: {n} diagnostic(s)", file=err)
        else:
            summary = json.loads(found.summary_json().first().json)
            if args.json:
                print(json.dumps(summary, indent=2), file=out)
            else:
                s = summary
                print(f"Pages: {s['pages']}\nTexts: {s['texts']}\nGraphics: {s['graphics']}", file=out)
                print(f"Images: {s['images']} ({s['image_resources']} shared resources)", file=out)
                print(f"Fonts: {s['fonts']}\nAnnotations: {s['annotations']}\nDiagnostics: {s['diagnostics']}", file=out)
                for p in s.get("page_details", []):
                    complete = str(p["interpretation_complete"]).lower()
                    print(f"Page {p['page']}: texts={p['texts']} graphics={p['graphics']} images={p['images']} interpretation_complete={complete}", file=out)
        return 0
    finally:
        found.close()


if __name__ == "__main__":
    sys.exit(main())
