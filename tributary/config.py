"""Project configuration from YAML. Unknown keys inside known sections are errors; unknown sections are ignored."""

from __future__ import annotations

from collections.abc import Mapping

# What each section may hold.
SECTIONS: dict[str, set[str] | None] = {
    "lint": {"preset", "rules", "categories", "exclude", "fail_on", "baseline"},
    "check": {"gates", "selection"},
    "docs": {"lineage_depth", "owner_key", "output"},
    "layers": None,
}


def read_config(text: str) -> dict:
    import yaml

    from tributary.operators import lineage, lint  # noqa: F401  (registers the rules on SQL facts)
    from tributary.operators.impact import GATES

    doc = yaml.safe_load(text) or {}
    if not isinstance(doc, Mapping):
        raise ValueError("the configuration isn't a mapping")
    for section, keys in SECTIONS.items():
        own = doc.get(section) or {}
        if keys is not None and (more := set(own) - keys):
            raise ValueError(f"unknown keys in {section}: {', '.join(sorted(more))}")
    rules = set((doc.get("lint") or {}).get("rules") or {})
    if more := rules - set(lint.RULES):
        raise ValueError(f"unknown rules: {', '.join(sorted(more))}")
    if more := set((doc.get("check") or {}).get("gates") or {}) - {g.id for g in GATES}:
        raise ValueError(f"unknown gates: {', '.join(sorted(more))}")
    if (preset := (doc.get("lint") or {}).get("preset", "standard")) not in ("minimal", "standard", "strict"):
        raise ValueError(f"unknown preset {preset!r}")
    return dict(doc)
