"""The selector language: text to syntax tree, tree to DataFrame.

White space is union, a comma intersection. ``2+name`` adds two levels upstream (``+name`` all of them), ``name+``
everything downstream. Atoms: a name or glob, ``tag:``, ``path:``, ``config.materialized:``, ``meta:key[=value]``,
``exposure:``, ``state:modified`` and ``state:new``. The validator and the evaluator share the tree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions import names as N
from tributary.functions.globs import is_glob, name_glob, path_glob
from tributary.operators import traverse
from tributary.plans.bundle import Bundle


@dataclass(frozen=True)
class Atom:
    method: str
    value: str


@dataclass(frozen=True)
class Factor:
    atom: Atom
    up: int | None = 0  # hops upstream; None: all
    down: bool = False


@dataclass(frozen=True)
class Selector:
    terms: tuple[tuple[Factor, ...], ...]

    def uses_state(self) -> bool:
        return any(f.atom.method == "state" for t in self.terms for f in t)


_FACTOR = re.compile(r"^(?:(?P<hops>\d*)\+)?(?P<atom>.*?)(?P<down>\+?)$", re.S)
_METHODS = ("tag", "path", "config.materialized", "meta", "exposure", "state")


def _atom(text: str) -> Atom:
    head, colon, value = text.partition(":")
    if colon and (head in _METHODS or head.startswith("config.")):
        return Atom(head, value)
    return Atom("name", text)


def parse(spec: str) -> Selector:
    """Lenient: empty pieces vanish, unknown methods are names."""
    terms = []
    for piece in spec.split():
        factors = []
        for part in piece.split(","):
            m = _FACTOR.match(part)
            if part and m and m["atom"]:
                hops = 0 if m["hops"] is None else int(m["hops"]) if m["hops"] else None
                factors.append(Factor(_atom(m["atom"]), hops, bool(m["down"])))
        if factors:
            terms.append(tuple(factors))
    return Selector(tuple(terms))


def validate(spec: str) -> Selector:
    """Strict: raises ``ValueError`` that names the bad piece."""
    if not spec.split():
        raise ValueError("empty selector")
    for piece in spec.split():
        for part in piece.split(","):
            if not part:
                raise ValueError(f"empty part in {piece!r}")
            m = _FACTOR.match(part)
            atom = m["atom"] if m else ""
            if not atom or atom.startswith("+") or atom.endswith("+") or atom == "@":
                raise ValueError(f"malformed selector {part!r}")
            head, colon, value = atom.partition(":")
            if colon:
                if head.startswith("config.") and head != "config.materialized":
                    raise ValueError(f"unsupported config key in {part!r}")
                if head not in _METHODS:
                    raise ValueError(f"unknown method {head!r} in {part!r}")
                if not value or (head == "meta" and not value.partition("=")[0]):
                    raise ValueError(f"no value in {part!r}")
                if head == "state" and value not in ("modified", "new"):
                    raise ValueError(f"unknown state {value!r}")
    return parse(spec)


def _paths(b: Bundle, value: str) -> DataFrame:
    pattern = path_glob(value)
    d = b.detail.select("unique_id", "original_file_path", "patch_path")
    d = b.nodes.select("unique_id", "path").join(d, "unique_id", "left")
    own = F.coalesce(N.normal_path(F.col("original_file_path")), N.normal_path(F.col("path")))
    parts = F.split(own, "/")
    places = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    legacy = N.normal_path(F.col("path")).rlike(pattern)
    hit = F.exists(places, lambda p: p.rlike(pattern)) | (N.project_path(F.col("patch_path")) == value.strip("/")) | legacy
    return d.where(F.coalesce(hit, legacy)).select("unique_id")


def _evaluate_atom(b: Bundle, atom: Atom, changes: DataFrame | None) -> DataFrame:
    ids = b.nodes.select("unique_id")
    v = atom.value
    if atom.method == "tag":
        return ids.join(b.detail.where(F.array_contains("tags", v)).select("unique_id"), "unique_id", "left_semi")
    if atom.method == "path":
        return _paths(b, v)
    if atom.method == "config.materialized":
        return b.nodes.where(F.col("materialized") == v).select("unique_id")
    if atom.method == "meta":
        key, equal, value = v.partition("=")
        hit = (F.col("meta")[key] == value) if equal else F.map_contains_key("meta", F.lit(key))
        return ids.join(b.detail.where(hit).select("unique_id"), "unique_id", "left_semi")
    if atom.method == "exposure":
        found = b.nodes.where((F.col("resource_type") == "exposure") & (F.col("name") == v)).select("unique_id")
        return found.unionByName(traverse.closure(b.edges, found, "up").select("unique_id")).distinct()
    if atom.method == "state":
        if changes is None:
            return ids.limit(0)
        wanted = ["added"] if v == "new" else ["added", "modified"]
        return ids.join(changes.where(F.col("status").isin(wanted)).select("unique_id"), "unique_id", "left_semi")
    if atom.method != "name":
        return ids.limit(0)
    full = N.list_name(F.col("unique_id"), F.col("name"))
    if is_glob(v):
        pattern = name_glob(v)
        return b.nodes.where(F.col("name").rlike(pattern) | full.rlike(pattern)).select("unique_id")
    bare = F.when(N.is_versioned(F.col("unique_id")), F.concat("name", F.lit("."), N.normalize_version(N.segments(F.col("unique_id"))[3])))
    return b.nodes.where((F.col("name") == v) | (full == v) | F.coalesce(bare == v, F.lit(False))).select("unique_id")


def _evaluate_factor(b: Bundle, factor: Factor, changes: DataFrame | None) -> DataFrame:
    base = _evaluate_atom(b, factor.atom, changes)
    out = base
    if factor.up is None or factor.up > 0:
        out = out.unionByName(traverse.closure(b.edges, base, "up", factor.up).select("unique_id"))
    if factor.down:
        out = out.unionByName(traverse.closure(b.edges, base, "down").select("unique_id"))
    return out.distinct()


def select(b: Bundle, spec: str | Selector, changes: DataFrame | None = None) -> DataFrame:
    """The set of unique_ids that ``spec`` picks. ``changes`` (unique_id, status) gives ``state:`` its meaning."""
    selector = parse(spec) if isinstance(spec, str) else spec
    out = b.nodes.select("unique_id").limit(0)
    for term in selector.terms:
        found = _evaluate_factor(b, term[0], changes)
        for factor in term[1:]:
            found = found.intersect(_evaluate_factor(b, factor, changes))
        out = out.unionByName(found)
    return out.distinct()


def listed(b: Bundle, include: list[str] | None = None, exclude: list[str] | None = None, changes: DataFrame | None = None) -> DataFrame:
    """Rows (unique_id, list_name, resource_type) by uid: the union of ``include`` (default: all) less ``exclude``."""
    found = b.nodes.select("unique_id")
    if include:
        found = select(b, " ".join(include), changes)
    if exclude:
        found = found.subtract(select(b, " ".join(exclude), changes))
    out = b.nodes.join(found, "unique_id", "left_semi")
    return out.select("unique_id", N.list_name(F.col("unique_id"), F.col("name")).alias("list_name"), "resource_type").orderBy("unique_id")
