"""gitignore rules: anchored, directory-only and negated patterns, ``**``, the last match wins, nothing
below an ignored directory comes back."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path


def _regex(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern[i:] == "**" and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif c == "*":
            while i < len(pattern) and pattern[i] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (m := re.compile(r"\[([!^]?)(\]?[^\]]*)\]").match(pattern, i)):
            out, i = out + f"(?!/)[{'^' if m[1] else ''}{re.sub(r'([\\\[\]])', r'\\\1', m[2])}]", m.end()
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


@dataclass(frozen=True)
class Rule:
    base: str
    regex: re.Pattern
    directory_only: bool
    keep: bool
    #: Of a rule from above the walk's root: the path from its directory to the root, with a slash at the end.
    above: str = ""


def rules(text: str, base: str = "") -> list[Rule]:
    """The rules of one ignore file that stands in ``base`` ('' or a path that ends in /)."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep else line
        directory_only = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        line = line.lstrip("/")
        if line:
            out.append(Rule(base, re.compile(("" if anchored else "(?:.*/)?") + _regex(line)), directory_only, keep))
    return out


class Ignore:
    """The rules in force along a walk; files further down and later lines count more."""

    def __init__(self, in_force: list[Rule] | None = None):
        self.in_force = in_force or []

    def below(self, directory: Path, base: str, git: bool) -> Ignore:
        """With the directory's own files; .gitignore only inside a git repository."""
        more = []
        for name in ([".gitignore"] if git else []) + [".ignore"]:
            try:
                more += rules((directory / name).read_text("utf-8", "replace"), base)
            except OSError:
                pass
        return Ignore(self.in_force + more) if more else self

    def ignored(self, path: str, is_dir: bool) -> bool:
        for rule in reversed(self.in_force):
            if (is_dir or not rule.directory_only) and path.startswith(rule.base) and rule.regex.fullmatch(rule.above + path[len(rule.base) :]):
                return not rule.keep
        return False
