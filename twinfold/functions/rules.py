"""Include and exclude rules: an ordered list, last match wins, default include."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from .globs import path_regex, python_match
from .paths import proper_ancestors

#: Folder of the tool's own metadata: always the first rule.
BUILT_IN_EXCLUDE = ".twinfold"


@dataclass(frozen=True)
class Rule:
    pattern: str
    exclude: bool

    def parts(self) -> tuple[str | None, bool]:
        """Expression, and whether it is for single components rather than the whole path."""
        p = self.pattern.removesuffix("/")
        if not p:
            return None, False
        if p.startswith("/"):
            return path_regex(p[1:]), False
        return path_regex(p), "/" not in p

    def matches(self, path: str) -> bool:
        regex, single = self.parts()
        if regex is None:
            return False
        return any(python_match(regex, c) for c in (path.split("/") if single else [path]))

    def column(self, path: Column) -> Column:
        regex, single = self.parts()
        if regex is None:
            return F.lit(False)
        if single:
            return F.exists(F.split(path, "/"), lambda c: c.rlike(regex))
        return path.rlike(regex)


def parse_rules(text: str, default_exclude: bool) -> list[Rule]:
    """One rule a line; `+ ` includes, `- ` excludes, blank lines and `#` lines are skipped."""
    out = []
    for line in map(str.strip, text.splitlines()):
        if not line or line[0] == "#":
            continue
        if line[:2] in ("+ ", "- "):
            out.append(Rule(line[2:], line[0] == "-"))
        else:
            out.append(Rule(line, default_exclude))
    return out


def load_rules(file: str, default_exclude: bool) -> list[Rule]:
    return parse_rules(Path(file).read_text(encoding="utf-8"), default_exclude)


def rule_list(include=(), include_from=None, exclude=(), exclude_from=None, built_in=BUILT_IN_EXCLUDE) -> list[Rule]:
    """Built-in, include flags, include file, exclude flags, exclude file, in this order."""
    rules = [Rule(built_in, True), *(Rule(p, False) for p in include)]
    if include_from:
        rules += load_rules(include_from, False)
    rules += [Rule(p, True) for p in exclude]
    if exclude_from:
        rules += load_rules(exclude_from, True)
    return rules


def excluded_path(rules: list[Rule], path: str) -> bool:
    return reduce(lambda acc, r: r.exclude if r.matches(path) else acc, rules, False)


def excluded(rules: list[Rule], path: Column) -> Column:
    """The rules' verdict on one path, without its ancestors'."""
    return reduce(lambda acc, r: F.when(r.column(path), F.lit(r.exclude)).otherwise(acc), rules, F.lit(False))


def pruned(rules: list[Rule], relpath: Column) -> Column:
    """Whether a file is hidden: itself excluded, or below an excluded directory."""
    return excluded(rules, relpath) | F.exists(proper_ancestors(relpath), lambda p: excluded(rules, p))
