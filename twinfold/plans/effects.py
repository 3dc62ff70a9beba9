"""Carrying plans out: dispose (dry, unlink or trash), verified copies, empty directories.

Nothing else in the library changes files. Dispose and prune run on the driver, over a
plan streamed from Spark; copies run on the executors.
"""

from __future__ import annotations

import errno
import hashlib
import json
import os
import time
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import encoded
from ..functions.media import probed
from ..sources.sidecars import SUFFIX, json_text

MODES = ("dry-run", "unlink", "trash")


# --- trash ---------------------------------------------------------------------


def _device(path: str) -> int:
    try:
        return os.stat(path).st_dev
    except OSError:
        return os.stat(os.path.dirname(path)).st_dev


def mount_point(path: str) -> str:
    """The last directory above path that is on its device."""
    at, device = os.path.normpath(path), _device(path)
    while (up := os.path.dirname(at)) != at:
        try:
            if _device(up) != device:
                break
        except OSError:
            break
        at = up
    return at


def trash_folder(path: str, home: str | None = None) -> tuple[str, str]:
    """The trash for a path, and the directory that recorded paths are relative to ('' for
    the home trash, which records whole paths)."""
    home = home or os.path.expanduser("~")
    if home and os.path.isdir(home) and _device(path) == _device(home):
        base = os.environ.get("XDG_DATA_HOME") or os.path.join(home, ".local", "share")
        return os.path.join(base, "Trash"), ""
    top = mount_point(path)
    return os.path.join(top, f".Trash-{os.getuid()}"), top


def trash(path: str, home: str | None = None, clock=time.localtime) -> str:
    """Moves a file to the trash of its own file system; returns its new place. The restore
    record is made first, under a name that is free for both, and taken back on failure."""
    path = os.path.abspath(path)
    folder, top = trash_folder(path, home)
    places = {k: os.path.join(folder, k) for k in ("files", "info")}
    for p in places.values():
        os.makedirs(p, mode=0o700, exist_ok=True)
    recorded = encoded(os.path.relpath(path, top) if top else path)
    text = f"[Trash Info]\nPath={recorded}\nDeletionDate={time.strftime('%Y-%m-%dT%H:%M:%S', clock())}\n"
    base, n = os.path.basename(path), 0
    while True:
        name = f"{base}.{n}" if n else base
        target, record = os.path.join(places["files"], name), os.path.join(places["info"], f"{name}.trashinfo")
        n += 1
        if os.path.lexists(target):
            continue
        try:
            fd = os.open(record, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
        except FileExistsError:
            continue
        with os.fdopen(fd, "w") as f:
            f.write(text)
        try:
            os.rename(path, target)
        except OSError:
            os.unlink(record)
            raise
        return target


# --- dispose --------------------------------------------------------------------


def dispose(plan: DataFrame, mode: str = "dry-run", unverified: bool = False, log=print) -> dict:
    """Carries out the rows of action `dispose`; counts and bytes. Rows whose evidence is
    not content are refused unless `unverified`."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r} (valid: {', '.join(MODES)})")
    done = {"files": 0, "bytes": 0, "failed": 0, "refused": 0}
    for r in plan.where("action = 'dispose'").toLocalIterator():
        if r["evidence"] != "content" and not unverified:
            done["refused"] += 1
            continue
        try:
            if mode == "unlink":
                os.unlink(r["path"])
            elif mode == "trash":
                trash(r["path"])
        except OSError as e:
            done["failed"] += 1
            log(f"{r['path']}: {e}")
            continue
        done["files"] += 1
        done["bytes"] += r["size"]
    return done


def prune_empty(directories: Iterable[str]) -> list[str]:
    """Removes directories that hold nothing, from the bottom up."""
    gone = []
    for top in directories:
        for d, _, _ in os.walk(top, topdown=False):
            try:
                os.rmdir(d)
                gone.append(d)
            except OSError as e:
                if e.errno not in (errno.ENOTEMPTY, errno.EEXIST, errno.ENOENT):
                    raise
    return gone


# --- verified copy ------------------------------------------------------------------


def read_back(path: str, hashes: list[str], chunk: int, full: bool) -> None:
    """Compares the last chunk (full: each chunk) with its hash; raises OSError."""
    with open(path, "rb") as f:
        for k in range(0 if full else max(0, len(hashes) - 1), len(hashes)):
            f.seek(k * chunk)
            if hashlib.md5(f.read(chunk), usedforsecurity=False).hexdigest() != hashes[k]:
                raise OSError(f"chunk {k} of {path} differs from what was written")


def copy_file(source: str, target: str, chunk: int = 64 << 20, full: bool = False, media: dict | None = None) -> dict:
    """Copies with whole and chunk hashes, keeps mtime, reads back, writes a sidecar (with media
    facts if there are any). A failed copy leaves no target. A file is never copied onto itself."""
    if os.path.exists(target) and os.path.samefile(source, target):
        raise OSError(f"{source} and {target} are the same file")
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    whole, hashes, size = hashlib.md5(usedforsecurity=False), [], 0
    state = os.stat(source)
    try:
        with open(source, "rb") as a, open(target, "wb") as b:
            while part := a.read(chunk):
                b.write(part)
                whole.update(part)
                hashes.append(hashlib.md5(part, usedforsecurity=False).hexdigest())
                size += len(part)
            b.flush()
            os.fsync(b.fileno())
        os.utime(target, ns=(state.st_atime_ns, state.st_mtime_ns))
        read_back(target, hashes, chunk, full)
    except BaseException:
        if os.path.exists(target):
            os.unlink(target)
        raise
    facts = {"size": size, "mtime": state.st_mtime_ns // 10**9, "md5": whole.hexdigest(), "chunk_size": chunk, "chunk_md5": hashes, "media": media}
    with open(target + SUFFIX, "w") as f:
        f.write(json_text(facts))
    return facts


def copy_tree(spark, source: str, target: str, transfers: int = 4, chunk: int = 64 << 20, full: bool = False, media: bool = False) -> DataFrame:
    """Copies all regular files but sidecars on `transfers` tasks: path, size, md5, error.
    media: files are probed, and what is found goes into their sidecars. Executors have to see
    both folders."""
    from ..sources import walk

    files = walk.read(spark, [source]).where("accepted").select("path", "relpath").repartition(transfers)
    facts = F.to_json("media") if media else F.lit(None).cast("string")
    if media:
        files = probed(files, "relpath")
    files = files.select("path", "relpath", facts.alias("facts"))

    def run(batches):
        for b in batches:
            out = []
            for path, rel, known in zip(*(b.column(c).to_pylist() for c in ("path", "relpath", "facts"))):
                try:
                    facts = copy_file(path, os.path.join(target, rel), chunk, full, json.loads(known or "null") or None)
                    out.append((path, facts["size"], facts["md5"], None))
                except OSError as e:
                    out.append((path, None, None, str(e)))
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["path", "size", "md5", "error"])

    return files.mapInArrow(run, "path string, size long, md5 string, error string")

