"""Project-source loader: a tree of yml, sql, py, csv and md files becomes a bundle without compiling anything.

Files are read by Spark and parsed on the executors into rows; names are resolved by joins. Stages: the project file,
models, Python models, seeds and snapshots, property files, edges, properties with the precedence file > property
file > project tree > default, docs blocks, and what is disabled.
"""

from __future__ import annotations

import ast
import csv
import io
import json
import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import names as N
from tributary.functions.sql_text import calls, without_comments
from tributary.plans.bundle import CONSTRAINT, FRESHNESS, SCHEMAS, Bundle, bundle
from tributary.session import written

FOLDERS = {"model-paths": ["models"], "seed-paths": ["seeds"], "snapshot-paths": ["snapshots"], "macro-paths": ["macros"]}
TEXT_FILES = (".sql", ".py", ".csv", ".yml", ".yaml", ".md")
_CONFIG = re.compile(r"\{\{-?\s*config\s*\((.*?)\)\s*-?\}\}", re.S)
_SNAPSHOT = re.compile(r"\{%-?\s*snapshot\s+(\w+)\s*-?%\}(.*?)\{%-?\s*endsnapshot\s*-?%\}", re.S)
_MACRO = re.compile(r"\{%-?\s*macro\s+(\w+)\s*\((.*?)\)\s*-?%\}(.*?)\{%-?\s*endmacro\s*-?%\}", re.S)
_DOCS = re.compile(r"\{%-?\s*docs\s+(\w+)\s*-?%\}(.*?)\{%-?\s*enddocs\s*-?%\}", re.S)


def _literal(text: str) -> object:
    """A literal that both Python and templates write alike; None for anything else."""
    try:
        return ast.literal_eval({"true": "True", "false": "False", "none": "None"}.get(text.strip().lower(), text.strip()))
    except (ValueError, SyntaxError):
        return None


def config_of(sql: str) -> dict:
    """Keyword arguments with literal values of all ``config`` calls; later calls win."""
    out: dict = {}
    for m in _CONFIG.finditer(without_comments(sql)):
        body = re.sub(r"\btrue\b", "True", re.sub(r"\bfalse\b", "False", re.sub(r"\bnone\b", "None", m[1])))
        try:
            call = ast.parse(f"f({body})", mode="eval").body
        except SyntaxError:
            continue
        for k in call.keywords:  # type: ignore[attr-defined]
            if k.arg:
                try:
                    out[k.arg] = ast.literal_eval(k.value)
                except ValueError:
                    out[k.arg] = None
    return out


def python_calls(code: str) -> tuple[list[tuple[str, tuple[str, ...]]], dict]:
    """(calls, config) of a Python model: ``dbt.ref``, ``dbt.source``, ``dbt.config`` with literal arguments."""
    found, config = [], {}
    try:
        tree = ast.parse(code)
    except SyntaxError:
        return [], {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name) and node.func.value.id == "dbt":
            args = tuple(a.value for a in node.args if isinstance(a, ast.Constant) and isinstance(a.value, str))
            if node.func.attr in ("ref", "source") and len(args) == len(node.args) and args:
                found.append((node.func.attr, args))
            elif node.func.attr == "config":
                config |= {k.arg: k.value.value for k in node.keywords if k.arg and isinstance(k.value, ast.Constant)}
    return found, config


class Unproven(Exception):
    """An expression whose value the text alone doesn't tell."""


def enabled(expression: object, variables: Mapping[str, object]) -> bool:
    """Whether a node is on: literals, ``var``, comparisons, and/or/not, ``in``, ``as_bool``. What can't be proven off is on."""
    if not isinstance(expression, str):
        return expression is not False
    text = re.sub(r"^\s*\{\{-?|-?\}\}\s*$", "", expression).strip()
    text = re.sub(r"\|\s*as_bool", "", re.sub(r"\btrue\b", "True", re.sub(r"\bfalse\b", "False", re.sub(r"\bnone\b", "None", text))))
    try:
        value = _value(ast.parse(text, mode="eval").body, variables)
    except (Unproven, SyntaxError, TypeError):
        return True
    return not (value is False or (isinstance(value, str) and value.strip().lower() == "false"))


def _value(e: ast.expr, variables: Mapping[str, object]) -> object:
    if isinstance(e, ast.Constant):
        return e.value
    if isinstance(e, (ast.List, ast.Tuple)):
        return [_value(x, variables) for x in e.elts]
    if isinstance(e, ast.Call) and isinstance(e.func, ast.Name) and e.func.id == "var" and e.args:
        name = _value(e.args[0], variables)
        if name in variables:
            return variables[name]
        if len(e.args) > 1:
            return _value(e.args[1], variables)
        raise Unproven
    if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.Not):
        return not _value(e.operand, variables)
    if isinstance(e, ast.BoolOp):
        out: object = None
        for x in e.values:
            out = _value(x, variables)
            if bool(out) != isinstance(e.op, ast.And):
                return out
        return out
    if isinstance(e, ast.Compare) and len(e.ops) == 1:
        a, b = _value(e.left, variables), _value(e.comparators[0], variables)
        tests = {ast.Eq: lambda: a == b, ast.NotEq: lambda: a != b, ast.Lt: lambda: a < b, ast.LtE: lambda: a <= b, ast.Gt: lambda: a > b, ast.GtE: lambda: a >= b, ast.In: lambda: a in b, ast.NotIn: lambda: a not in b}
        if type(e.ops[0]) in tests:
            return tests[type(e.ops[0])]()
    raise Unproven


def project_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of all text files below ``folder``, paths relative to it."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = "/" + folder.rstrip("/").split("/")[-1] + "/"
    d = d.where(F.col("path").rlike(r"\.(sql|py|csv|yml|yaml|md)$"))
    return d.select(F.substring_index("path", root, -1).alias("path") if folder.count(root.strip("/")) == 1 else F.expr(f"substring(path, locate('{root}', path) + {len(root)})").alias("path"), F.decode("content", "UTF-8").alias("text"))


def _yaml(text: str, path: str = "") -> dict:
    """The document, which must be a mapping or empty; anything else fails with the file's name."""
    import yaml

    try:
        doc = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise ValueError(f"{path}: not valid YAML: {e}") from e
    if not isinstance(doc, dict):
        raise ValueError(f"{path}: not a mapping")
    return doc


_ROW = "kind string, name string, path string, code string, language string, config string, calls string, columns string"


def _parse(batches: Iterator[pd.DataFrame], paths: Mapping[str, list[str]]) -> Iterator[pd.DataFrame]:
    """One row for each model, seed, snapshot, macro, docs block and property file."""
    under = lambda path, key: any(path.startswith(f"{p}/") for p in paths[key])
    for pdf in batches:
        rows = []

        def add(kind: str, name: str, path: str, code: str, language: str, config: dict, found: list, columns: list | None = None) -> None:
            rows.append((kind, name, path, code, language, json.dumps(config, default=str), json.dumps(found), json.dumps(columns or [])))

        for r in pdf.itertuples(index=False):
            stem, _, ext = r.path.rsplit("/", 1)[-1].rpartition(".")
            if ext == "sql" and under(r.path, "snapshot-paths"):
                for m in _SNAPSHOT.finditer(r.text):
                    add("snapshot", m[1], r.path, m[2], "sql", config_of(m[2]), [(c.head, c.arguments, c.version) for c in calls(m[2])])
            elif ext == "sql" and under(r.path, "model-paths"):
                add("model", stem, r.path, r.text, "sql", config_of(r.text), [(c.head, c.arguments, c.version) for c in calls(r.text)])
            elif ext == "sql" and under(r.path, "macro-paths"):
                for m in _MACRO.finditer(r.text):
                    add("macro", m[1], r.path, m[0], "sql", {"params": [p.split("=")[0].strip() for p in m[2].split(",") if p.strip()]}, sorted(set(re.findall(r"\b(\w+)\s*\(", m[3]))))
            elif ext == "py" and under(r.path, "model-paths"):
                found, config = python_calls(r.text)
                add("model", stem, r.path, r.text, "python", config, [(h, a, None) for h, a in found])
            elif ext == "csv" and under(r.path, "seed-paths"):
                header = next(csv.reader(io.StringIO(r.text)), [])
                add("seed", stem, r.path, "", "", {}, [], header)
            elif ext in ("yml", "yaml") and "/" in r.path:
                add("properties", stem, r.path, r.text, "", {}, [])
            elif ext == "md":
                for m in _DOCS.finditer(r.text):
                    add("docs", m[1], r.path, m[2].strip(), "", {}, [])
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in _ROW.split(", ")])


_PROPERTY = "kind string, name string, description string, config string, columns string, tests string, extra string, path string"


def _properties(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each entry of the property files; sources give one for each table."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            doc = _yaml(r.code, r.path)
            for section, kind in (("models", "model"), ("seeds", "seed"), ("snapshots", "snapshot"), ("exposures", "exposure"), ("semantic_models", "semantic_model"), ("metrics", "metric"), ("saved_queries", "saved_query"), ("sources", "source")):
                for entry in doc.get(section) or []:
                    if not isinstance(entry, dict) or not entry.get("name"):
                        continue
                    tables = entry.get("tables") or [] if kind == "source" else [entry]
                    for e in tables:
                        config = {**(entry.get("config") or {}), **(e.get("config") or {})}
                        for key in ("tags", "meta", "access", "group", "latest_version", "deprecation_date", "contract", "materialized", "loader", "loaded_at_field", "freshness", "versions"):
                            for holder in (entry, e):
                                if key in holder:
                                    config[key] = holder[key]
                        if kind == "source":
                            config |= {"source_name": entry["name"], "schema": entry.get("schema", entry["name"]), "database": entry.get("database"), "identifier": e.get("identifier", e["name"])}
                        columns = [{"name": c.get("name"), "data_type": c.get("data_type"), "description": c.get("description")} for c in e.get("columns") or [] if isinstance(c, dict)]
                        tests = []
                        for holder, column in [(e, None), *[(c, c.get("name")) for c in e.get("columns") or [] if isinstance(c, dict)]]:
                            for t in [*(holder.get("tests") or []), *(holder.get("data_tests") or [])]:
                                name, args = (t, {}) if isinstance(t, str) else next(iter(t.items()))
                                tests.append({"kind": str(name).split(".")[-1], "column": (args or {}).get("column_name", column), "to": str((args or {}).get("to", "")), "field": (args or {}).get("field")})
                        if kind == "model" and isinstance(e.get("versions"), list):
                            rows += _versions(e, config, columns, tests, r.path)
                            continue
                        extra = {"type": e.get("type"), "owner": e.get("owner"), "url": e.get("url"), "depends_on": [str(x) for x in e.get("depends_on") or [] if isinstance(x, str)]} if kind == "exposure" else {}
                        if kind == "snapshot" and isinstance(e.get("relation"), str):  # a snapshot without a file
                            extra = {"depends_on": [e["relation"]], "relation": e["relation"]}
                        rows.append((kind, e["name"], (e.get("description") or "").strip() or None, json.dumps(config, default=str), json.dumps(columns, default=str), json.dumps(tests, default=str), json.dumps(extra, default=str), r.path))
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in _PROPERTY.split(", ")])


def _versions(entry: dict, config: dict, columns: list, tests: list, path: str) -> list[tuple]:
    """One row for each version of a model, under the stem of its file: ``defined_in``, else ``name_vN``; the latest one's file
    may also be called like the model. The latest is the one the entry names, else the greatest."""
    listed = [v for v in entry["versions"] if isinstance(v, dict) and v.get("v") is not None]
    text = lambda v: str(v).lstrip("vV")
    order = lambda v: (0, float(v), "") if re.fullmatch(r"\d+(\.\d+)?", v) else (1, 0.0, v)
    latest = text(entry["latest_version"]) if entry.get("latest_version") is not None else max((text(v["v"]) for v in listed), key=order, default=None)
    out = []
    for v in listed:
        number = text(v["v"])
        own = {**config, **(v.get("config") or {}), "version": number, "family": entry["name"], "latest_version": latest}
        kept = columns
        for c in v.get("columns") or []:
            if isinstance(c, dict) and ("include" in c or "exclude" in c):
                some, without = c.get("include", "all"), _listed(c.get("exclude"))
                kept = [x for x in columns if (some in ("all", "*") or x["name"] in _listed(some)) and x["name"] not in without]
        kept = kept + [{"name": c["name"], "data_type": c.get("data_type"), "description": c.get("description")} for c in v.get("columns") or [] if isinstance(c, dict) and c.get("name")]
        stems = [v["defined_in"]] if v.get("defined_in") else [f"{entry['name']}_v{number}", *([entry["name"]] if number == latest else [])]
        description = (v.get("description") or entry.get("description") or "").strip() or None
        for stem in stems:
            out.append(("model", str(stem).removesuffix(".sql"), description, json.dumps(own, default=str), json.dumps(kept, default=str), json.dumps(tests, default=str), "{}", path))
    return out


def load_project(spark: SparkSession, folder: str, variables: Mapping[str, object] | None = None) -> Bundle:
    return load_files(spark, project_files(spark, folder), variables)


def load_files(spark: SparkSession, files: DataFrame, variables: Mapping[str, object] | None = None) -> Bundle:
    """A project given as (path, text)."""
    project = files.where(F.col("path").isin("dbt_project.yml", "dbt_project.yaml")).first()
    if project is None:
        raise FileNotFoundError("no project file")
    settings = _yaml(project["text"], project["path"])
    name = settings.get("name") or "project"
    variables = {**(settings.get("vars") or {}), **((settings.get("vars") or {}).get(name) or {}), **(variables or {})}
    paths = {k: list(settings.get(k) or v) for k, v in FOLDERS.items()}
    parsed = written(files.mapInPandas(lambda it: _parse(it, paths), _ROW), "project-rows")
    props = written(parsed.where("kind = 'properties'").mapInPandas(_properties, _PROPERTY), "project-properties")
    rows = _resolved(spark, parsed, props, settings, name, variables)
    return _bundled(spark, rows, parsed, name)


def _tree(settings: Mapping, section: str, project: str, path: str) -> dict:
    """``+key`` settings of the project tree along a path; deeper ones win, tags add up."""
    node, out = (settings.get(section) or {}).get(project) or {}, {}
    for part in [None, *path.split("/")[1:-1]]:
        node = node if part is None else node.get(part) if isinstance(node.get(part), dict) else None
        if node is None:
            break
        for k, v in node.items():
            if k.startswith("+") or not isinstance(v, dict):
                key = k.lstrip("+")
                out[key] = [*out.get("tags", []), *([v] if isinstance(v, str) else v)] if key == "tags" else v
    return out


def _listed(v: object) -> list:
    return [] if v is None else [v] if isinstance(v, str) else list(v) if isinstance(v, (list, tuple)) else []


_NODE = (
    "unique_id string, name string, kind string, path string, original_file_path string, materialized string, description string, tags array<string>, meta map<string,string>, access string, "
    "grp string, contract boolean, unique_key array<string>, strategy string, deprecation string, language string, version string, latest string, database string, schema string, identifier string, "
    f"warn_after {FRESHNESS}, error_after {FRESHNESS}, code string, calls array<struct<head:string,package:string,name:string,version:string>>, columns array<struct<name:string,data_type:string,description:string>>, "
    "tests array<struct<kind:string,column:string,to:string,field:string>>, exposure_type string, owner_name string, owner_email string, url string, declared boolean"
)


def _resolved(spark: SparkSession, parsed: DataFrame, props: DataFrame, settings: Mapping, project: str, variables: Mapping) -> DataFrame:
    """One row for each enabled node, with everything that files, properties and the tree say about it."""
    files = parsed.where("kind in ('model', 'seed', 'snapshot')").select(F.struct("kind", "name").alias("key"), F.struct("path", "code", "language", "config", "calls", "columns").alias("f"))
    declared = props.groupBy("kind", "name", F.get_json_object("config", "$.source_name").alias("of")).agg(F.max_by(F.struct("description", "config", "columns", "tests", "extra", "path"), "path").alias("p"))
    declared = declared.select(F.struct("kind", "name").alias("key"), "of", "p")
    fields = [f.split(" ")[0] for f in re.split(r", (?=\w+ )", _NODE)]
    frozen, values = json.loads(json.dumps(settings, default=str)), dict(variables)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                f, p = r.f, r.p
                kind, name = r.key["kind"], r.key["name"]
                tree = _tree(frozen, {"model": "models", "seed": "seeds", "snapshot": "snapshots"}.get(kind, "sources"), project, f["path"] if f is not None else p["path"])
                own = json.loads(f["config"]) if f is not None else {}
                yml = json.loads(p["config"]) if p is not None else {}
                get = lambda k, d=None: next((c[k] for c in (own, yml, tree) if c.get(k) is not None), d)  # noqa: B023, E731
                if not enabled(get("enabled", True), values):
                    continue
                columns = json.loads(p["columns"]) if p is not None else []
                header = json.loads(f["columns"]) if f is not None else []
                if header and not columns:
                    columns = [{"name": c, "data_type": None, "description": None} for c in header]
                found = [{"head": h, "package": a[0] if len(a) > 1 else None, "name": a[-1], "version": v} for h, a, v in json.loads(f["calls"])] if f is not None else []
                extra = json.loads(p["extra"]) if p is not None else {}
                for text in extra.get("depends_on", []):
                    m = re.match(r"(ref|source)\((.*)\)$", text.strip())
                    a = [_literal(x) for x in m[2].split(",")] if m else []
                    if a and all(isinstance(x, str) for x in a):
                        found.append({"head": m[1], "package": a[0] if len(a) > 1 else None, "name": a[-1], "version": None})
                owner, fresh = extra.get("owner") or {}, get("freshness") or {}
                limit = lambda k: {"count": fresh[k]["count"], "period": fresh[k].get("period")} if isinstance(fresh.get(k), dict) and fresh[k].get("count") is not None else None  # noqa: B023, E731
                version = yml.get("version") if "family" in yml else None
                if version is not None:
                    name = yml["family"]
                middle = f"{get('source_name')}.{name}" if kind == "source" else name if version is None else f"{name}.v{version}"
                default = {"model": "view", "seed": "seed", "snapshot": "snapshot"}.get(kind)
                meta = get("meta") or {}
                contract = get("contract") or {}
                text = lambda v: v if isinstance(v, str) else None if v is None else json.dumps(v)
                path = f["path"] if f is not None else p["path"]
                out.append((
                    f"{kind}.{project}.{middle}", name, kind, path.split("/", 1)[-1] if f is not None else path, path, get("materialized", default), p["description"] if p is not None else None,
                    sorted({*_listed(own.get("tags")), *_listed(yml.get("tags")), *_listed(tree.get("tags"))}), {k: v if isinstance(v, str) else json.dumps(v, separators=(",", ":")) for k, v in meta.items()},
                    get("access"), get("group"), contract.get("enforced") if isinstance(contract, dict) else None, [k for k in _listed(get("unique_key")) if k.strip()], get("incremental_strategy"),
                    text(get("deprecation_date")), f["language"] if f is not None else None, version, text(get("latest_version")), get("database"), get("schema"), get("identifier", get("alias")), limit("warn_after"), limit("error_after"),
                    f["code"] if f is not None and kind != "seed" else None, found, columns, json.loads(p["tests"]) if p is not None else [], extra.get("type"), owner.get("name"), owner.get("email"), extra.get("url"), p is not None,
                ))
            yield pd.DataFrame(out, columns=fields)

    joined = files.join(declared, "key", "full_outer")
    # a property entry of a model, seed or snapshot without a file declares nothing
    bare = F.get_json_object("p.extra", "$.relation").isNotNull() & (F.col("key.kind") == "snapshot")
    joined = joined.where(F.col("f").isNotNull() | ~F.col("key.kind").isin("model", "seed", "snapshot") | bare)
    return written(joined.select("key", "f", "p").mapInPandas(build, _NODE), "project-nodes")


def _bundled(spark: SparkSession, rows: DataFrame, parsed: DataFrame, project: str) -> Bundle:
    null = F.lit(None)
    called = rows.select(F.col("unique_id").alias("child"), F.explode("calls").alias("c"))
    refs = rows.where("kind in ('model', 'seed', 'snapshot')").select(
        F.col("unique_id").alias("parent"), F.col("name").alias("target"), F.col("version").alias("of_version"), F.coalesce(F.col("version") == F.col("latest"), F.lit(True)).alias("newest")
    )
    tables = rows.where("kind = 'source'").select(F.col("unique_id").alias("parent"), F.concat(N.segments(F.col("unique_id"))[2], F.lit("."), "name").alias("target"))
    wanted = called.select("child", "c.head", N.normalize_version(F.col("c.version")).alias("asked"), F.when(F.col("c.head") == "source", F.concat_ws(".", "c.package", "c.name")).otherwise(F.col("c.name")).alias("target"))
    # a call names one version, or means the latest
    named = wanted.where("head = 'ref'").join(refs, "target").where("case when asked is null then newest else asked = of_version end")
    resolved = named.select("child", "target", "parent").unionByName(wanted.where("head = 'source'").join(tables, "target").select("child", "target", "parent"))
    lost = wanted.join(resolved.select("child", "target").distinct(), ["child", "target"], "left_anti").count()
    own = {
        "description": "description", "tags": "tags", "meta": "meta", "access": "access", "grp": "grp", "contract_enforced": "contract", "unique_key": "unique_key", "incremental_strategy": "strategy",
        "deprecation_date": "deprecation", "language": "language", "version": "version", "latest_version": "latest", "database": "database", "schema": "schema", "identifier": "identifier",
        "original_file_path": "original_file_path", "warn_after": "warn_after", "error_after": "error_after",
    }
    fields = [(f.split(" ")[0], f.split(" ", 1)[1]) for f in re.split(r", (?=\w+ )", SCHEMAS["detail"])][1:]
    given = {"package_name": F.lit(project), "semantic_dependents": F.array(), "constraints": F.array().cast(f"array<{CONSTRAINT}>")}
    detail = rows.select("unique_id", *[(F.col(own[n]) if n in own else given.get(n, null)).cast(t).alias(n) for n, t in fields])
    tests = rows.select("unique_id", "name", F.explode("tests").alias("t"))
    target = F.regexp_extract("t.to", r"ref\(\s*['\"]([^'\"]+)['\"]\s*\)", 1)
    tests = tests.withColumn("target", F.when(target != "", target)).join(refs.where("newest").select("target", F.col("parent").alias("ref_uid")), "target", "left")
    macros = parsed.where("kind = 'macro'")
    uid = lambda c: F.concat(F.lit(f"macro.{project}."), c)
    inner = macros.select("name", F.explode(F.from_json("calls", "array<string>")).alias("callee"))
    overview = parsed.where("kind = 'docs' and name = '__overview__'").first()
    return bundle(
        spark,
        rows.select("unique_id", "name", F.col("kind").alias("resource_type"), "path", "materialized"),
        written(resolved.select("parent", "child").distinct(), "project-edges"),
        detail=detail,
        columns=rows.select("unique_id", F.posexplode("columns").alias("pos", "c")).select("unique_id", "pos", "c.name", "c.data_type", F.when(N.present(F.col("c.description")), F.col("c.description")).alias("description"), F.array().cast(f"array<{CONSTRAINT}>").alias("constraints")),
        tests=tests.select("unique_id", F.concat_ws("_", "t.kind", "name", "t.column").alias("name"), F.col("t.kind").alias("kind"), F.col("t.column").alias("column_name"), "ref_uid", F.col("target").alias("ref_name"), F.col("t.field").alias("ref_column")),
        node_sql=rows.where("code is not null").select("unique_id", F.col("code").alias("raw_code"), null.cast("string").alias("compiled_code"), F.lit(False).alias("stale")),
        exposures=rows.where("kind = 'exposure'").select("unique_id", "exposure_type", "owner_name", "owner_email", "url"),
        macros=macros.select(uid(F.col("name")).alias("uid"), "name", F.col("code").alias("sql"), F.from_json(F.get_json_object("config", "$.params"), "array<string>").alias("params")),
        macro_edges=inner.join(macros.select(F.col("name").alias("callee")), "callee").select(uid(F.col("name")).alias("caller"), uid(F.col("callee")).alias("callee")),
        root_project=project,
        overview=overview and overview["code"],
        warnings=[f"{lost} references name nothing in the project"] if lost else [],
    )
