"""python -m strandline COMMAND: init, import, keep, ask, context, kg, correct, corrections, undo, pages, lint, export, smoke, diagnose, rebuild."""

from __future__ import annotations

import argparse
import json
import os

from strandline.dataset import Dataset, choose
from strandline.operators import graph
from strandline.session import clean, local_session


def main() -> None:
    p = argparse.ArgumentParser(prog="strandline", description=__doc__)
    p.add_argument("--root", default=os.environ.get("STRANDLINE_ROOT", "archives"))
    p.add_argument("--slug")
    sub = p.add_subparsers(dest="command", required=True)
    add = sub.add_parser("import")
    add.add_argument("source")
    add.add_argument("--persona", default="")
    add.add_argument("--since")
    add.add_argument("--dry-run", action="store_true")
    add.add_argument("--equivalent", choices=("block", "allow", "reconcile"), default="block")
    sub.add_parser("init").add_argument("name")
    sub.add_parser("keep").add_argument("source_file")
    ctx = sub.add_parser("context")
    ctx.add_argument("source")
    ctx.add_argument("--about")
    ctx.add_argument("--apply", action="store_true")
    sub.add_parser("pages")
    sub.add_parser("lint").add_argument("--fix-links", action="store_true")
    sub.add_parser("smoke")
    ask = sub.add_parser("ask")
    ask.add_argument("question")
    ask.add_argument("--about", required=True)
    ask.add_argument("--limit", type=int, default=5)
    ask.add_argument("--evidence-budget", type=int, default=2500)
    kg = sub.add_parser("kg")
    kg.add_argument("--entity")
    kg.add_argument("--path", nargs=2)
    kg.add_argument("--stats", action="store_true")
    sub.add_parser("correct").add_argument("text")
    sub.add_parser("corrections")
    sub.add_parser("undo").add_argument("claim")
    export = sub.add_parser("export")
    export.add_argument("target")
    export.add_argument("--pii-policy", choices=("block", "redact", "allow"), default="block")
    sub.add_parser("diagnose")
    sub.add_parser("rebuild")
    a = p.parse_args()
    spark = local_session()
    d = Dataset(spark, a.root, a.slug if a.command == "init" and a.slug else choose(spark, a.root, a.slug), getattr(a, "persona", ""))
    if a.command == "import":
        out = d.preview(a.source, a.since) if a.dry_run else d.add(a.source, a.since, a.equivalent)
    elif a.command == "ask":
        out = d.ask(a.question, a.about, a.limit, a.evidence_budget)
    elif a.command == "kg":
        e = d.effective()
        rows = graph.neighbourhood(e, a.entity) if a.entity else graph.statistics(e)
        out = graph.path(e, *a.path) if a.path else [r.asDict() for r in rows.collect()]
    elif a.command == "context":
        shown = d.preview_context(a.source, a.about)
        out = d.add_context(shown) if a.apply else shown | {"records": [r.asDict() for r in shown["records"].orderBy("number").collect()]}
    elif a.command == "corrections":
        out = [r.asDict() for r in d.ledger()[0].orderBy("ord").collect()]
    else:
        out = {"correct": lambda: d.correct(a.text), "undo": lambda: d.undo(a.claim), "export": lambda: d.export(a.target, a.pii_policy), "diagnose": d.diagnose, "rebuild": d.rebuild, "init": lambda: d.create(a.name), "keep": lambda: d.keep_only(a.source_file), "pages": d.build_pages, "lint": lambda: d.lint(a.fix_links), "smoke": d.smoke}[a.command]()
    print(json.dumps(out, ensure_ascii=False, indent=2, default=str))
    clean(spark)


if __name__ == "__main__":
    main()
