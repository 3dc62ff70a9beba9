"""Options of a run, and the engine's session settings."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .functions.scalars import parse_duration, parse_size
from .plans.effects import MODES
from .plans.report import FORMATS, checked


@dataclass(frozen=True)
class Options:
    roots: tuple[str, ...]
    checksum: bool = False
    include: tuple[str, ...] = ()
    include_from: str | None = None
    exclude: tuple[str, ...] = ()
    exclude_from: str | None = None
    min_size: int = 0
    max_size: int = 0
    recursive: bool = True
    one_file_system: bool = False
    within_root: bool = False
    cross_root_trees: bool = False
    cache: str | None = None
    use_cache: bool = True
    cache_max_age: float = 0.0
    rehash: bool = False
    format: str = "columns"
    out: str | None = None
    trees: bool = True
    overlap: bool = True
    overlap_block: int = 30
    overlap_least: int = 2
    overlap_depth: int = 1
    remove_by_glob: str | None = None
    dispose: str = "dry-run"
    delete: bool = False
    unverified: bool = False
    sidecars: bool = True
    workers: int = 0
    quiet: bool = False
    verbose: bool = False
    progress: bool = False

    @property
    def cross_root(self) -> bool:
        """Groups have to span roots if there are several, unless asked otherwise."""
        return len(self.roots) > 1 and not self.within_root


def parse(argv: list[str]) -> Options:
    p = argparse.ArgumentParser(prog="twinfold", description="Find duplicate files and directories.")
    p.add_argument("roots", nargs="+")
    for name in ("checksum", "one-file-system", "within-root", "cross-root-trees", "rehash", "delete", "unverified", "quiet", "verbose", "progress"):
        p.add_argument(f"--{name}", action="store_true")
    for name in ("no-recursive", "no-trees", "no-overlap", "no-sidecars", "no-cache"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--workers", type=int, default=0, help="tasks that read files (0: four for each core)")
    for name in ("include", "exclude"):
        p.add_argument(f"--{name}", action="append", default=[])
        p.add_argument(f"--{name}-from")
    p.add_argument("--min-size", type=parse_size, default=0)
    p.add_argument("--max-size", type=parse_size, default=0)
    p.add_argument("--cache", help="folder of the hash cache (default: in the user's cache folder)")
    p.add_argument("--cache-max-age", type=parse_duration, default=0.0)
    p.add_argument("--format", type=checked, default="columns", help=", ".join(FORMATS))
    p.add_argument("--out")
    p.add_argument("--overlap-block", type=int, default=30)
    p.add_argument("--overlap-least", type=int, default=2)
    p.add_argument("--overlap-depth", type=int, default=1)
    p.add_argument("--remove-by-glob")
    p.add_argument("--dispose", choices=MODES, default="dry-run")
    a = vars(p.parse_args(argv))
    for name in ("recursive", "trees", "overlap", "sidecars"):
        a[name] = not a.pop(f"no_{name}")
    a["use_cache"] = not a.pop("no_cache")
    return Options(**{k: tuple(v) if isinstance(v, list) else v for k, v in a.items()})


@dataclass(frozen=True)
class CopyOptions:
    source: str
    target: str
    transfers: int = 4
    chunk: int = 64 << 20
    full: bool = False
    media: bool = True


def parse_copy(argv: list[str]) -> CopyOptions:
    p = argparse.ArgumentParser(prog="twinfold copy", description="Copy a tree; verify what was written; leave sidecars.")
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--transfers", type=int, default=4)
    p.add_argument("--chunk", type=parse_size, default=64 << 20)
    p.add_argument("--full", action="store_true", help="read every chunk back, not only the last")
    p.add_argument("--no-media", action="store_true")
    a = vars(p.parse_args(argv))
    a["media"] = not a.pop("no_media")
    return CopyOptions(**a)


def session(master: str | None = None, **conf) -> SparkSession:
    """A session with the settings that the engine is tested with."""
    b = SparkSession.builder.appName("twinfold")
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.cleaner.referenceTracking.cleanCheckpoints": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
