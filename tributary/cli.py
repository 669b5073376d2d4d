"""Command line: ls, columns, lint, check, impact, docs. Exit codes: 0 passed, 1 a gate failed, 2 wrong use or input."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.config import read_config
from tributary.engine import Engine
from tributary.operators import attributes, diff, impact, lineage, lint, select
from tributary.plans.bundle import Bundle
from tributary.session import written
from tributary.sources import discovery, reports


def impact_markdown(base: Bundle, current: Bundle) -> str:
    """What a change reaches, as Markdown: changed nodes, affected ones by kind, owners, hubs, untested, CI selector."""
    changes = written(diff.node_changes(base, current), "changes")
    reached = impact.affected_nodes(current, changes)
    out = ["# Impact", ""]

    def listed(title: str, df: DataFrame, column: str) -> None:
        rows = [r[column] for r in df.orderBy(column).collect()]  # a report for people
        out.extend([f"## {title} ({len(rows)})", "", *[f"- {r}" for r in rows], ""] if rows else [])

    for status in ("added", "modified", "removed"):
        own = changes.where(F.col("status") == status)
        listed(status.capitalize(), own.select(F.concat("name", F.when(F.size("reasons") > 0, F.concat(F.lit(": "), F.array_join("reasons", ", "))).otherwise(F.lit(""))).alias("n")), "n")
    for kind in ("model", "mart", "exposure"):
        listed(f"Affected {kind}s", reached.where(F.col("kind") == kind), "name")
    listed("Owners", impact.owners(current, impact.changed_nodes(current, changes)), "owner")
    listed("Changed hubs", impact.changed_hubs(current, changes).select(F.concat("name", F.lit(": "), F.col("downstream").cast("string")).alias("n")), "n")
    listed("Untested changes", impact.untested_changes(current, changes), "name")
    selector = impact.ci_selectors(current, changes).first()["selector"]
    return "\n".join([*out, "## CI selector", "", f"`{selector}`", ""])


def fix_files(b: Bundle, found: DataFrame, project_dir: str) -> list[str]:
    """Writes the mended text of models to their files, and says what was done; a file that no longer holds the text that was
    judged stays."""
    said = []
    plan = lineage.fixes(b, found).join(b.detail.select("unique_id", F.col("original_file_path").alias("path")), "unique_id").join(b.node_sql.select("unique_id", "raw_code"), "unique_id")
    for r in plan.orderBy("unique_id").toLocalIterator():
        said += [f"refused\t{r['unique_id']}\t{x['rule']}\t{x['reason']}" for x in r["refused"]]
        if not r["applied"]:
            continue
        path = Path(project_dir, r["path"] or "")
        text = path.read_text(encoding="utf-8") if path.is_file() else None
        if text is None or text.strip() != (r["raw_code"] or "").strip():
            said.append(f"refused\t{r['unique_id']}\t{','.join(r['applied'])}\tthe file doesn't hold the text that was judged")
            continue
        blank = text[len(text.rstrip()) :]
        path.write_text(text[: len(text) - len(text.lstrip())] + r["fixed_code"].strip() + blank, encoding="utf-8")
        said.append(f"fixed\t{r['unique_id']}\t{','.join(r['applied'])}")
    return said


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tributary")
    p.add_argument("verb", choices=["ls", "columns", "lint", "check", "impact", "docs"])
    p.add_argument("argument", nargs="*", help="selectors; for columns: unique_id column")
    p.add_argument("--manifest")
    p.add_argument("--source", help="a project folder, read without a manifest")
    p.add_argument("--project-dir", default=".", help="where to look for target/manifest.json, else the project file")
    p.add_argument("--catalog")
    p.add_argument("--run-results")
    p.add_argument("--base", help="what to compare with: a manifest, a folder, or git:<revision>")
    p.add_argument("--baseline", help="file of findings that don't count")
    p.add_argument("--write-baseline", action="store_true", help="replace that file by what is found")
    p.add_argument("--fix", action="store_true", help="delete trailing semicolons and unread CTEs from the project's files")
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--format", default="text")
    p.add_argument("--direction", choices=["up", "down"], default="up")
    p.add_argument("--config")
    p.add_argument("--output", default="docs")
    p.add_argument("--scope", choices=["root", "all"], default="root")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tributary").getOrCreate()
    try:
        config = {}
        if a.config:
            with open(a.config) as f:
                config = read_config(f.read())
        inputs = discovery.discover(spark, a.project_dir, a.manifest, a.source, a.catalog, a.run_results)
        detected = a.manifest is None and a.source is None
        loaded = discovery.load(spark, inputs, a.project_dir if detected else None)
        engine = Engine(attributes.root_scope(loaded) if a.scope == "root" else loaded)
        for note in loaded.warnings:
            print(f"warning: {note}", file=sys.stderr)
        base = discovery.baseline(spark, a.base, a.source or a.project_dir, a.scope) if a.base else None
        frozen = None
        if a.baseline and not a.write_baseline:
            with open(a.baseline) as f:
                frozen = lint.read_baseline(spark, f.read())
        for spec in [*(a.argument if a.verb in ("ls", "lint") else []), *a.exclude]:
            select.validate(spec)
    except (ValueError, OSError, AnalysisException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    b = engine.bundle
    if a.verb == "ls":
        changes = diff.node_changes(base, b) if base is not None else None
        form = a.format if a.format != "text" else "names"
        _print(reports.listing(select.listed(b, a.argument or None, a.exclude or None, changes), form))
    elif a.verb == "columns":
        for r in engine.columns(*a.argument[:2], direction=a.direction).collect():
            print(f"{r['node']}.{r['column']}\t{','.join(r['kinds'])}\t{r['confidence']}")
    elif a.verb == "lint":
        judged = written(engine.lint(config.get("lint"), baseline=frozen), "findings")
        if a.baseline and a.write_baseline:
            with open(a.baseline, "w") as f:
                f.write(lint.baseline_text(judged.where("class <> 'suppressed'")))
            return 0
        if a.argument:
            judged = judged.join(select.select(b, " ".join(a.argument)), "unique_id", "left_semi")
        if a.fix:
            for line in fix_files(b, judged.where("class = 'counted'"), a.source or a.project_dir):
                print(line)
            return 0
        _print(_ordered(reports.report(judged.where("class = 'counted'"), a.format, b)))
        gates = lint.gate_rows(judged, (config.get("lint") or {}).get("fail_on", "error"))
        return int(not gates.where("status = 'fail'").isEmpty())
    elif a.verb == "check":
        gates = written(impact.gate_results(b, base, (config.get("check") or {}).get("gates")), "gates")
        for r in gates.orderBy("rank").collect():  # ten rows
            print(f"{r['status']}\t{r['gate']}\t{'' if r['value'] is None else r['value']}")
        return int(not gates.where("status = 'fail'").isEmpty())
    elif a.verb == "impact":
        if base is None:
            print("error: impact needs --base", file=sys.stderr)
            return 2
        print(impact_markdown(base, b))
    else:
        print(reports.save_pages(reports.docs_pages(b, (config.get("docs") or {}).get("owner_key", "owner")), a.output if "://" in a.output else f"file://{a.output}"))
    return 0


def _ordered(lines: DataFrame) -> DataFrame:
    return lines.orderBy(*[c for c in ("part", "n") if c in lines.columns])


def _print(lines: DataFrame) -> None:
    for r in lines.select("line").toLocalIterator():
        print(r["line"])


if __name__ == "__main__":
    sys.exit(main())
