"""Names: identifiers, versions, layers, predicates over node types. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Resource types and layers.
EXCLUDED_TYPES = ("test", "operation", "analysis", "check")
TESTABLE_TYPES = ("model", "snapshot", "seed")
DATA_TYPES = ("model", "snapshot", "seed", "source")
LAYERS = ("staging", "intermediate", "marts", "utilities")
PREFIXES = {"staging": ("stg_",), "intermediate": ("int_",), "marts": ("fct_", "dim_", "rpt_")}


def normalize_column(name: Column) -> Column:
    """Unquoted names fold to lower case; quoted ones ("x", `x`, [x]) keep their case without the quotes."""
    t = F.trim(name)
    quoted = t.rlike(r'^(".*"|`.*`|\[.*\])$') & (F.length(t) >= 2)
    return F.when(quoted, t.substr(F.lit(2), F.length(t) - 2)).otherwise(F.lower(t))


def normalize_version(version: Column) -> Column:
    """Without one leading v or V."""
    return F.regexp_replace(version, "^[vV]", "")


def segments(uid: Column) -> Column:
    return F.split(uid, r"\.")


def package(uid: Column) -> Column:
    """Second segment; null for a uid without segments."""
    s = segments(uid)
    return F.when(F.size(s) > 1, s[1])


def in_package(uid: Column, name: str) -> Column:
    """A uid without segments is always in scope."""
    return F.coalesce(package(uid) == name, F.lit(True))


def is_versioned(uid: Column) -> Column:
    s = segments(uid)
    return (F.size(s) == 4) & (s[0] == "model")


def list_name(uid: Column, name: Column) -> Column:
    """``name.vN`` for versioned models, else the name."""
    return F.when(is_versioned(uid), F.concat(name, F.lit("."), segments(uid)[3])).otherwise(name)


def family_name(uid: Column, name: Column) -> Column:
    """What all versions of a model share: package and name."""
    return F.concat_ws(".", F.coalesce(package(uid), F.lit("")), name)


def display_name(uid: Column, name: Column, resource_type: Column) -> Column:
    """A source shows as ``source.table``."""
    s = segments(uid)
    return F.when((resource_type == "source") & (F.size(s) >= 4), F.concat(s[2], F.lit("."), name)).otherwise(list_name(uid, name))


def pluralize(n: Column, singular: str, plural: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {singular}")).otherwise(F.lit(f" {plural or singular + 's'}")))


def normal_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def project_path(patch_path: Column) -> Column:
    """A patch path without its ``package://``."""
    return F.regexp_replace(normal_path(patch_path), "^[^/]*://", "")


def layer(path: Column) -> Column:
    """First directory of a path; ``other`` for a file without one."""
    parts = F.split(normal_path(path), "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit("other"))


def layer_rank(layer_name: Column) -> Column:
    rank = F.lit(len(LAYERS))
    for k, name in reversed(list(enumerate(LAYERS))):
        rank = F.when(layer_name == name, F.lit(k)).otherwise(rank)
    return rank


def lint_layer(name: Column, path: Column, prefixes: dict[str, tuple[str, ...]] | None = None, directories: dict[str, str] | None = None) -> Column:
    """By name prefix (the alphabetically first layer), else by directory if configured, else ``other``."""
    return F.coalesce(prefix_layer(name, prefixes), directory_layer(path, directories), F.lit("other"))


def prefix_layer(name: Column, prefixes: dict[str, tuple[str, ...]] | None = None) -> Column:
    out = F.lit(None).cast("string")
    for key, starts in sorted((prefixes or PREFIXES).items(), reverse=True):
        hit = F.lit(False)
        for s in starts:
            hit = hit | name.startswith(s)
        out = F.when(hit, F.lit(key)).otherwise(out)
    return out


def directory_layer(path: Column, directories: dict[str, str] | None = None) -> Column:
    directories = directories if directories is not None else {k: k for k in PREFIXES}
    out = F.lit(None).cast("string")
    for key, directory in sorted(directories.items(), reverse=True):
        out = F.when(layer(path) == directory, F.lit(key)).otherwise(out)
    return out


def present(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def meta_string(value: Column) -> Column:
    """A JSON scalar without its quotes; anything else as it stands."""
    return F.when(value.rlike(r'^".*"$'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)


def constraint_label(c: Column) -> Column:
    """One line: type, name, columns, expression, reference."""
    part = lambda x, f: F.when(x.isNotNull() & (x != ""), f(x))
    text = F.concat_ws(
        " ",
        c["type"],
        part(c["name"], lambda x: x),
        F.when(F.size(c["columns"]) > 0, F.concat(F.lit("("), F.array_join(c["columns"], ", "), F.lit(")"))),
        part(c["expression"], lambda x: x),
        part(c["to"], lambda x: F.concat(F.lit("-> "), x, F.when(F.size(c["to_columns"]) > 0, F.concat(F.lit("("), F.array_join(c["to_columns"], ", "), F.lit(")"))).otherwise(F.lit("")))),
    )
    return F.regexp_replace(text, r"[\r\n]+", " ")


def capped(names: Column, cap: int = 5) -> Column:
    """The first names, then how many more there are."""
    more = F.size(names) - cap
    return F.concat(F.array_join(F.slice(names, 1, cap), ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def fuzzy_pattern(query: str) -> str:
    """Pattern of all names that hold the query's characters in order; white space doesn't count."""
    special = set(r"\.[]{}()*+-?^$|&#~")
    return "(?is)" + ".*".join(("\\" + c) if c in special else c for c in query if not c.isspace())


def name_matches(name: Column, query: str) -> Column:
    return name.rlike(fuzzy_pattern(query))


def match_positions(name: Column, query: str) -> Column:
    """Places (from 0) of the query's characters in the name, each as early as possible; null where they don't match."""
    wanted = [c.lower() for c in query if not c.isspace()]
    out, at, ok = F.array().cast("array<int>"), F.lit(0), F.lit(True)
    for c in wanted:
        found = F.call_function("locate", F.lit(c), F.lower(name), at + 1)
        ok, out, at = ok & (found > 0), F.concat(out, F.array((found - 1).cast("int"))), found
    return F.when(ok, out)


def degree_heat(downstream: Column) -> Column:
    """By transitive downstream count: 0 none, 1-2 low, 3-6 mid, 7 and more high."""
    return F.when(downstream <= 0, "none").when(downstream <= 2, "low").when(downstream <= 6, "mid").otherwise("high")


def time_heat(seconds: Column) -> Column:
    s = F.coalesce(seconds, F.lit(0.0))
    return F.when(s < 1, "none").when(s < 10, "low").when(s < 60, "mid").otherwise("high")


def status_class(status: Column) -> Column:
    return F.when(status.isin("error", "fail"), "error").when(status == "warn", "warn").when(status == "skipped", "skipped").otherwise("none")


def mid_truncated(name: Column, cells: int) -> Column:
    """At most ``cells`` characters: what is cut from the middle becomes one ellipsis; the end keeps the greater half."""
    head = (cells - 1) // 2
    tail = cells - 1 - head
    cut = F.concat(F.substring(name, 1, head), F.lit("\u2026"), F.substring(name, -tail, tail) if tail > 0 else F.lit(""))
    return F.when(F.length(name) <= cells, name).when(F.lit(cells) <= 0, F.lit("")).otherwise(cut)
