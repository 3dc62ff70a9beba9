"""A whole run over roots on disk: scan, hash, trees, groups, overlap, queue, plan, reports."""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.paths import virtual_column
from .functions.rules import rule_list
from .lineage import cut
from .operators import groups, hashing, overlap, trees
from .options import Options, parse, parse_copy, session
from .plans import effects, queue, report
from .sources import cache, sidecars, walk


def scan(spark: SparkSession, o: Options) -> DataFrame:
    rules = rule_list(o.include, o.include_from, o.exclude, o.exclude_from)
    return walk.read(spark, list(o.roots), rules, o.min_size, o.max_size, o.recursive, o.one_file_system)


def analyse(spark: SparkSession, o: Options, now: int | None = None) -> dict[str, DataFrame]:
    """The tables of a run: files, groups, members, trees, blocks, queue, plan."""
    now = int(time.time()) if now is None else now
    scanned = cut(scan(spark, o))
    errors = scanned.where("error is not null").select("path", "error")
    every = scanned.where("error is null")
    files = groups.first_of_inode(every.where("accepted")).drop("accepted", "error").withColumn("md5", F.lit(None).cast("string"))
    key = groups.CONTENT if o.checksum else groups.FAST
    if o.checksum:
        wanted = groups.candidates(files, o.cross_root)
        side = None
        if o.sidecars:
            side = sidecars.read(spark, *walk.root_list(list(o.roots)))
        folder = (o.cache or cache.default_folder()) if o.use_cache else None
        known = cache.read(spark, folder) if folder else None
        tasks = o.workers or 4 * spark.sparkContext.defaultParallelism
        hashed = cut(hashing.resolve(wanted, side, known, now, o.cache_max_age, o.rehash, tasks=tasks))
        if folder:
            cache.append(hashed, folder, now)
        errors = errors.unionByName(hashed.where("hash_error is not null").select("path", F.col("hash_error").alias("error")))
        files = files.drop("md5").join(hashed.select("path", "md5"), "path", "left")
    # tables that those below are made of several times
    files = cut(files)
    found = groups.groups(files, key, o.cross_root)
    rows = cut(groups.members(files, key, o.cross_root))
    pairs = spark.createDataFrame([], "dir_a string, root_a string, dir_b string, root_b string, file_count long, total_size long")
    classes = None
    if o.trees:
        gaps = trees.incomplete_directories(every)
        classes = trees.identical_classes(files, "content" if o.checksum else "fast", gaps)
        pairs = trees.pairs_of(classes)
        if o.checksum:
            more = trees.covering_trees(files, rows, prune=False, strict=True, incomplete=gaps)
            pairs = pairs.unionByName(more).dropDuplicates(["dir_a", "dir_b"])
        pairs = cut(trees.undominated(pairs))
        if o.cross_root_trees:
            pairs = pairs.where("root_a <> root_b")
    column = F.col("root") if len(o.roots) > 1 else virtual_column(F.col("path"), F.col("root"), o.overlap_depth)
    items = cut(overlap.items(rows, column, o.overlap_block, o.overlap_least))
    if not o.overlap:
        items = items.limit(0)
    blocks = overlap.blocks(items)
    ids = found.withColumn("gid", F.concat_ws(":", *key))
    rest = overlap.remaining(ids, items)
    loose = rows.join(rest.select("gid"), "gid", "left_semi")
    sides = overlap.block_files(items, rows, column)
    if o.remove_by_glob:
        gone_groups = queue.by_glob(loose, o.remove_by_glob)
        dropped = queue.glob_side(pairs, "dir_a", "dir_b", o.remove_by_glob)
        gone_sides = queue.glob_side(sides, "col_a", "col_b", o.remove_by_glob)
    else:
        gone_groups = queue.keep_first(loose)
        dropped = queue.oriented(pairs, "dir_a", "dir_b")
        gone_sides = queue.oriented(sides, "col_a", "col_b")
    wanted = {"tree": queue.tree_disposals(files, dropped), "overlap": queue.dropped_files(gone_sides), "group": gone_groups.where("action = 'dispose'").select("path")}
    identity = files if o.checksum else files.withColumn("md5", F.col("mtime").cast("string"))
    plan = queue.disposal_plan(identity, wanted, "content" if o.checksum else "size and mtime")
    items = queue.tree_items(files, dropped.select("drop", F.when(F.col("drop") == F.col("dir_a"), F.col("dir_b")).otherwise(F.col("dir_a")).alias("keep")))
    return {
        "files": files, "groups": found, "members": rows, "trees": pairs, "classes": classes, "blocks": blocks, "errors": errors, "queue": queue.queue(pairs, blocks, rest),
        "items": items.unionByName(queue.group_items(loose)), "dropped": dropped.select("drop").distinct(), "plan": cut(plan),
    }


def warnings(got: dict[str, DataFrame], log) -> None:
    """What could not be read, and classes of directories too large for all of their pairs."""
    for r in got["errors"].limit(100).collect():
        log(f"{r['path']}: {r['error']}")
    n = got["errors"].count()
    if n > 100:
        log(f"{n - 100} more entries could not be read")
    if got["classes"] is not None:
        for r in trees.large_classes(got["classes"]).collect():
            log(f"{r['dirs']} directories are identical to {r['class_id']}: each is paired with that one only")


def main_copy(argv: list[str]) -> int:
    o = parse_copy(argv)
    failed = effects.copy_tree(session(), o.source, o.target, o.transfers, o.chunk, o.full, o.media).where("error is not null").select("path", "error").collect()
    for r in failed:
        print(f"{r['path']}: {r['error']}", file=sys.stderr)
    return int(bool(failed))


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["copy"]:
        return main_copy(argv[1:])
    o = parse(argv)
    spark = session(**{"spark.ui.showConsoleProgress": str(o.progress).lower()})
    got = analyse(spark, o)
    if not o.quiet:
        warnings(got, lambda text: print(text, file=sys.stderr))
    if o.verbose:
        for name in ("files", "groups", "trees", "blocks"):
            print(f"{name}: {got[name].count()}")
    if o.out:
        report.write_trees(got["trees"], o.format, f"{o.out}/trees")
        report.write_groups(groups.nested(got["members"]), o.format, f"{o.out}/groups")
        for name in ("plan", "items", "errors"):
            got[name].write.parquet(f"{o.out}/{name}")
    else:
        for r in queue.best_actions(got["queue"], 50).collect():
            print(r["kind"], r["waste"], r["keep"], r["drop"])
    if o.delete:
        tops = [r["drop"] for r in got["dropped"].collect()] if o.dispose != "dry-run" else []
        print(effects.dispose(got["plan"], o.dispose, o.unverified))
        effects.prune_empty(tops)
    return 0


if __name__ == "__main__":
    sys.exit(main())
