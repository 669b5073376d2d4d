"""Globs as Java regular expressions, translated once on the driver."""

from __future__ import annotations

_SPECIAL = set(r"\.[]{}()*+-?^$|&#~")


def _quoted(c: str) -> str:
    return "\\" + c if c in _SPECIAL else c


def _set(glob: str, at: int, path: bool) -> tuple[str, int] | None:
    """The character class that starts at ``[``, and where it ends; None if it isn't closed."""
    i = at + 1
    negated = glob[i : i + 1] == "!"
    i += negated
    end = glob.find("]", i + 1)  # a ] right after the start is a member
    if end < 0:
        return None
    body = "".join("\\" + c if c in r"\[]&^~" else c for c in glob[i:end])
    if negated:
        return f"[^{'/' if path else ''}{body}]", end + 1
    return (f"(?!/)[{body}]" if path else f"[{body}]"), end + 1


def name_glob(glob: str) -> str:
    """``* ? [set] [!set]`` over a whole name."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (got := _set(glob, i, False)):
            out, i = out + got[0], got[1]
            continue
        else:
            out += _quoted(c)
        i += 1
    return f"(?s)^{out}$"


def path_glob(glob: str) -> str:
    """Like ``name_glob``, but ``*`` and ``?`` stay inside a segment and a segment ``**`` spans any number of them."""
    parts = glob.strip("/").split("/")
    out = ""
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
            continue
        i = 0
        while i < len(part):
            c = part[i]
            if c == "*":
                out += "[^/]*"
            elif c == "?":
                out += "[^/]"
            elif c == "[" and (got := _set(part, i, True)):
                out, i = out + got[0], got[1]
                continue
            else:
                out += _quoted(c)
            i += 1
        out += "" if last else "/"
    return f"(?s)^{out}$"


def is_glob(text: str) -> bool:
    return any(c in text for c in "*?[")
