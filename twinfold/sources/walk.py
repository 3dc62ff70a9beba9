"""Files on disk as a table: a data source that reads metadata only, never contents.

A partition is an entry of a root, or of a directory some levels down where roots have few
entries, so that even one large directory is walked side by side. Rows come for all regular files (no links, pipes, sockets or devices); `accepted` tells
which of them the rules and bounds let through, so that a directory's real
count stays known. Hidden names are included. Entries that cannot be read give a
row with `error`.
"""

from __future__ import annotations

import json
import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.rules import Rule, excluded_path
from .sidecars import is_sidecar

SCHEMA = "path string, relpath string, root string, size bigint, mtime bigint, inode bigint, dev bigint, source int, accepted boolean, error string"


#: Partitions that the driver looks for, and levels that it goes down for them.
PARTS, LEVELS = 64, 4


class Part(InputPartition):
    def __init__(self, source: int, root: str, entry: str, hidden: bool = False):
        self.source, self.root, self.entry, self.hidden = source, root, entry, hidden


class WalkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"])
        self.rules = [Rule(*r) for r in json.loads(options.get("rules", "[]"))]
        self.low, self.high = int(options.get("minsize", 0)), int(options.get("maxsize", 0))
        self.recursive = options.get("recursive", "true") == "true"
        self.one_device = options.get("onefilesystem", "false") == "true"
        self.sidecars = options.get("sidecars", "false") == "true"

    def partitions(self):
        out = []
        for k, root in enumerate(self.roots):
            out += self._below(Part(k, root, "")) or [Part(k, root, "")]
        for _ in range(LEVELS):
            if len(out) >= PARTS:
                break
            out = [p for q in out for p in (self._below(q) if q.entry and self._opens(q) else [q])]
        return out or [Part(0, "", "")]

    def _opens(self, part: Part) -> bool:
        """Whether a part is a directory that its reader would walk; what cannot be read it reports."""
        path = os.path.join(part.root, part.entry)
        try:
            at = os.lstat(path)
            same = not self.one_device or at.st_dev == os.stat(part.root).st_dev
            return stat.S_ISDIR(at.st_mode) and self.recursive and same and not self._nested(part, path) and os.access(path, os.R_OK | os.X_OK)
        except OSError:
            return False

    def _below(self, part: Part) -> list[Part]:
        try:
            names = sorted(os.listdir(os.path.join(part.root, part.entry)))
        except OSError:
            return [part]  # the reader reports it
        hidden = part.hidden or bool(part.entry) and excluded_path(self.rules, part.entry)
        return [Part(part.source, part.root, os.path.join(part.entry, n), hidden) for n in names]

    def _nested(self, part: Part, path: str) -> bool:
        """Whether a path belongs to another root within this one."""
        return any(path == r for k, r in enumerate(self.roots) if k != part.source and r.startswith(part.root.rstrip("/") + "/"))

    def read(self, part: Part):
        if not part.root:
            return
        device = os.stat(part.root).st_dev if self.one_device and os.path.isdir(part.root) else None
        stack = [(os.path.join(part.root, part.entry) if part.entry else part.root, part.hidden)]
        while stack:
            path, hidden = stack.pop()
            rel = os.path.relpath(path, part.root)
            row = lambda size=None, at=None, ok=False, error=None: (path, rel, part.root, size, int(at.st_mtime // 1) if at else None, at.st_ino if at else None, at.st_dev if at else None, part.source, ok, error)  # noqa: B023, E731
            if self._nested(part, path):
                continue
            try:
                at = os.lstat(path)
            except OSError as e:
                yield row(error=str(e))
                continue
            hidden = hidden or excluded_path(self.rules, rel)
            if stat.S_ISDIR(at.st_mode):
                if not self.recursive or device is not None and at.st_dev != device:
                    continue
                try:
                    names = sorted(os.listdir(path), reverse=True)
                except OSError as e:
                    yield row(error=str(e))
                    continue
                stack += [(os.path.join(path, n), hidden) for n in names]
            elif stat.S_ISREG(at.st_mode) and is_sidecar(os.path.basename(path)) == self.sidecars:
                fits = at.st_size >= self.low and not (self.high and at.st_size > self.high)
                yield row(at.st_size, at, not hidden and fits)


class WalkSource(DataSource):
    """format("walk"): options roots and rules as JSON, minsize, maxsize, recursive, onefilesystem,
    sidecars (only these, else none)."""

    @classmethod
    def name(cls) -> str:
        return "walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WalkReader:
        return WalkReader({k.lower(): v for k, v in self.options.items()})


def root_list(paths: list[str]) -> list[str]:
    """Absolute roots without repeats, in order."""
    return list(dict.fromkeys(os.path.abspath(p) for p in paths))


def read(spark: SparkSession, roots: list[str], rules: list[Rule] = (), min_size: int = 0, max_size: int = 0, recursive: bool = True, one_file_system: bool = False, sidecars: bool = False) -> DataFrame:
    """All regular files below the roots (or, if asked for, their sidecars); a file below two roots belongs to the inner one.
    Links to one inode are all there: groups.first_of_inode drops the later ones."""
    spark.dataSource.register(WalkSource)
    options = {
        "roots": json.dumps(root_list(roots)), "rules": json.dumps([(r.pattern, r.exclude) for r in rules]), "minsize": str(min_size), "maxsize": str(max_size),
        "recursive": str(recursive).lower(), "onefilesystem": str(one_file_system).lower(), "sidecars": str(sidecars).lower(),
    }
    return spark.read.format("walk").options(**options).load()
