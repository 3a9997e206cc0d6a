"""Path expressions: language by suffix, ignore globs, relative paths."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paths ignored by default (gitignore syntax).
DEFAULT_IGNORES = (
    "__pycache__/",
    "*.pyc",
    "*.pyo",
    ".git/",
    ".venv/",
    "venv/",
    "node_modules/",
    "dist/",
    "build/",
    "*.egg-info/",
    ".pytest_cache/",
    ".mypy_cache/",
    ".ruff_cache/",
    ".DS_Store",
)

# Suffixes of the JavaScript family, matched case-insensitively.
JS_SUFFIXES = {
    "javascript": (".js", ".mjs", ".cjs", ".jsx"),
    "typescript": (".ts",),
    "tsx": (".tsx",),
}


def suffix(path: Column) -> Column:
    """Last dotted suffix of the file name; a name such as ``.py`` has none."""
    return F.regexp_extract(path, r"[^/.][^/]*(\.[^/.]+)$", 1)


def language(path: Column) -> Column:
    """python / javascript / typescript / tsx / null. ``.py`` is case-sensitive."""
    ext = suffix(path)
    out = F.when(ext == ".py", "python")
    for name, suffixes in JS_SUFFIXES.items():
        out = out.when(F.lower(ext).isin(*suffixes), name)
    return out


def _segment_regex(glob: str) -> str:
    """Regex for one glob segment without ``**``."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def glob_regex(glob: str) -> str:
    """Compile one gitignore pattern (without a leading ``!``) to a regex for ``rlike``."""
    directory = glob.endswith("/")
    body = glob.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    segments = body.split("/")
    out = "^" if anchored else "(?:^|/)"
    for i, seg in enumerate(segments):
        last = i == len(segments) - 1
        if seg == "**":
            out += "[^/].*" if last else "(?:[^/]+/)*"
        else:
            out += _segment_regex(seg) + ("" if last else "/")
    return out + ("/" if directory else "(?:/|$)")


def parse_ignore_lines(lines: Iterable[str]) -> list[tuple[bool, str]]:
    """(ignored?, regex) per pattern line, in order; blank and ``#`` lines are skipped."""
    parsed = []
    for line in lines:
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        parsed.append((not keep, glob_regex(line[1:] if keep else line)))
    return parsed


def ignored(path: Column, lines: Iterable[str]) -> Column:
    """One boolean expression in which the last matching pattern decides.

    Runs of patterns with the same sign are one alternation, so a path is tested by few regexes.
    """
    groups: list[tuple[bool, list[str]]] = []
    for sign, regex in parse_ignore_lines(lines):
        if groups and groups[-1][0] == sign:
            groups[-1][1].append(regex)
        else:
            groups.append((sign, [regex]))
    out = F.lit(False)
    for sign, regexes in groups:
        hit = path.rlike("|".join(f"(?:{r})" for r in regexes))
        out = F.when(hit, F.lit(sign)).otherwise(out)
    return out


def relative_to(path: Column, root: str) -> Column:
    """Path below ``root``; paths elsewhere stay as they are."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 2**31 - 1)).otherwise(path)
