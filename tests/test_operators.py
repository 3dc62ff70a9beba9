import random

import pytest
from pyspark.sql import functions as F

from twinfold import catalog
from twinfold.operators import groups, hashing, overlap, trees
from twinfold.plans import queue, report
from twinfold.plans.effects import MODES  # noqa: F401


def files(spark, rows):
    """rows: (root, relpath, size, mtime, md5); sources by order of roots."""
    roots = list(dict.fromkeys(r[0] for r in rows))
    out = [(f"{r}/{p}" if r != "/" else f"/{p}", p, r, s, t, k + 1, 1, roots.index(r), h) for k, (r, p, s, t, h) in enumerate(rows)]
    return spark.createDataFrame(out, catalog.FILES.replace(" not null", ""))


def pairs(df):
    return sorted((r.dir_a, r.dir_b) for r in df.collect())


BASE = [
    ("/A", "a.txt", 11, 1, "hello"), ("/A", "only.txt", 17, 2, "only"), ("/A", "four.bin", 4, 3, "f1"), ("/A", "tree/x", 5, 4, "x"), ("/A", "tree/y", 6, 5, "y"),
    ("/B", "b.txt", 11, 9, "hello"), ("/B", "four.bin", 4, 8, "f2"), ("/B", "tree2/x", 5, 4, "x"), ("/B", "tree2/y", 6, 5, "y"),
]


def test_groups(spark):
    f = files(spark, BASE)
    assert sorted(r["size"] for r in groups.collision_sizes(f).collect()) == [4, 5, 6, 11]
    assert groups.candidates(f).count() == 8
    assert sorted((r["size"], r.n, r.wasted) for r in groups.groups(f).collect()) == [(5, 2, 5), (6, 2, 6), (11, 2, 11)]
    assert sorted(r["size"] for r in groups.groups(f, groups.FAST).collect()) == [5, 6]
    assert groups.members(f).count() == 6
    assert groups.reclaimable(groups.groups(f)).first().asDict() == {"groups": 3, "files": 6, "wasted": 22}
    one = files(spark, [("/A", "p", 3, 1, "h"), ("/A", "q", 3, 1, "h"), ("/B", "r", 3, 1, None), ("/B", "s", 3, 1, "")])
    assert groups.groups(one, cross_root=True).count() == 0 and groups.groups(one).first().n == 2
    assert groups.groups(f.limit(0)).count() == 0 and groups.reclaimable(groups.groups(f.limit(0))).first().wasted == 0


def test_hardlinks(spark):
    f = files(spark, BASE[:4]).withColumn("inode", F.when(F.col("size") == 17, 0).when(F.col("size") == 4, 0).otherwise(7))
    assert sorted(r.relpath for r in groups.first_of_inode(f).collect()) == ["a.txt", "four.bin", "only.txt"]
    other = f.withColumn("dev", F.col("size"))
    assert groups.first_of_inode(other).count() == 4


def test_trees(spark):
    f = files(spark, BASE)
    assert pairs(trees.identical_trees(f, "fast")) == [("/A/tree", "/B/tree2")]
    assert pairs(trees.identical_trees(f, "content")) == [("/A/tree", "/B/tree2")]
    changed = f.withColumn("md5", F.when(F.col("path") == "/A/tree/x", "z").otherwise(F.col("md5")))
    assert pairs(trees.identical_trees(changed, "fast")) and not pairs(trees.identical_trees(changed, "content"))
    gaps = trees.incomplete_directories(f.withColumn("accepted", F.col("path") != "/A/tree/x"))
    assert not pairs(trees.identical_trees(f, "fast", incomplete=gaps))
    unknown = f.withColumn("md5", F.when(F.col("size") != 5, F.col("md5")))
    assert not pairs(trees.identical_trees(unknown, "content"))


ROTATION = [(r, p, len(p), k, p[-1]) for r in ("/P", "/Q") for k, p in enumerate(["common/xx", "common/yyy", "sub/mmmm", "sub/n"])]


def test_dominance_and_seeds(spark):
    f = files(spark, ROTATION)
    every = pairs(trees.identical_trees(f, "content", prune=False))
    assert every == [("/P", "/Q"), ("/P/common", "/Q/common"), ("/P/sub", "/Q/sub")]
    assert pairs(trees.identical_trees(f, "content")) == [("/P", "/Q")]
    seeds = trees.identical_trees(f, "content")
    assert pairs(trees.identical_trees(f, "content", seeds=seeds)) == []
    crossed = spark.createDataFrame([("/P", "/P", "/Q", "/Q"), ("/P/a", "/P", "/Q/b", "/Q"), ("/P/z", "/P", "/R", "/R")], "dir_a string, root_a string, dir_b string, root_b string")
    assert pairs(trees.undominated(crossed)) == [("/P", "/Q"), ("/P/z", "/R")]
    turned = spark.createDataFrame([("/R/a", "/R", "/R/b", "/R"), ("/R/a/x", "/R", "/R/b/y", "/R"), ("/R/a/k", "/R", "/R/a/l", "/R")], "dir_a string, root_a string, dir_b string, root_b string")
    assert pairs(trees.undominated(turned)) == [("/R/a", "/R/b"), ("/R/a/k", "/R/a/l")]


def test_coverage(spark):
    f = files(spark, ROTATION)
    assert pairs(trees.covering_trees(f, groups.members(f))) == [("/P", "/Q")]
    moved = files(spark, [("/P", "a/one", 3, 1, "u"), ("/P", "a/two", 4, 1, "v"), ("/Q", "b/c/uno", 3, 2, "u"), ("/Q", "b/c/due", 4, 2, "v")])
    assert ("/P/a", "/Q/b/c") in pairs(trees.covering_trees(moved, groups.members(moved), prune=False))
    lone = files(spark, [*[("/X", p, 3, 1, p) for p in "ab"], ("/Y", "a", 3, 1, "a")])
    assert pairs(trees.covering_trees(lone, groups.members(lone))) == []
    nested = files(spark, [("/r", "p/q/a", 3, 1, "h"), ("/r", "p/q/s/a", 3, 1, "h")])
    assert pairs(trees.covering_trees(nested, groups.members(nested))) == []
    counts = files(spark, [("/A", "1", 3, 1, "x"), ("/A", "2", 3, 1, "x"), ("/A", "3", 3, 1, "y"), ("/B", "1", 3, 1, "x"), ("/B", "2", 3, 1, "y"), ("/B", "3", 3, 1, "y")])
    rows = groups.members(counts)
    assert pairs(trees.covering_trees(counts, rows)) == [("/A", "/B")] and pairs(trees.covering_trees(counts, rows, strict=True)) == []


def test_large_classes_give_stars(spark):
    f = files(spark, [("/r", f"d{k}/{n}", 3, 1, n) for k in range(6) for n in "ab"] + [("/r", f"e{k}/{n}", 3, 1, n) for k in range(3) for n in "cd"])
    found = trees.identical_classes(f, "content").cache()
    assert trees.pairs_of(found).count() == 15 + 3 == trees.pairs_of(found, None).count()
    star = pairs(trees.pairs_of(found, 5))
    assert star == [*[("/r/d0", f"/r/d{k}") for k in range(1, 6)], ("/r/e0", "/r/e1"), ("/r/e0", "/r/e2"), ("/r/e1", "/r/e2")]
    assert [tuple(r) for r in trees.large_classes(found, 5).collect()] == [("/r/d0", 6)]
    assert pairs(trees.identical_trees(f, "content", whole=5)) == star


def test_thousands_of_equal_directories(spark):
    f = files(spark, [("/r", f"d{k:04d}/{n}", 3, 1, n) for k in range(2300) for n in "ab"])
    got = pairs(trees.identical_trees(f, "content", prune=False))
    assert got == [("/r/d0000", f"/r/d{k:04d}") for k in range(1, 2300)]


def test_classes_are_verified(spark):
    """Fingerprints that fall together by chance do not make directories equal."""
    f = files(spark, [("/r", f"{d}/{n}", 3, 1, n) for d, names in {"p": "ab", "q": "ab", "z": "cd"}.items() for n in names])
    rows = trees.in_directories(f)
    same = trees.fingerprints(rows, trees.ENTRIES["content"]).where("n = 2").withColumn("fp1", F.lit(0)).withColumn("fp2", F.lit(0))
    assert pairs(trees.pairs_of(trees.classes(same, rows, trees.ENTRIES["content"]))) == [("/r/p", "/r/q")]


def test_covering_classes_reach_beyond_the_lifted_form(spark):
    rows = [(f"/r{k:02d}", f"a/f{k}", 3, 1, "h") for k in range(60)]
    f = files(spark, rows)
    m = groups.members(f)
    all_pairs = trees.covering_trees(f, m, prune=False).where("dir_a like '%/a' and dir_b like '%/a'").count()
    assert all_pairs == 60 * 59 // 2 > trees.lifted_trees(f, m, prune=False).where("dir_a like '%/a' and dir_b like '%/a'").count()


def test_order_of_input_does_not_matter(spark):
    rng = random.Random(1)
    rows = [*BASE, *ROTATION]
    rng.shuffle(rows)
    a, b = files(spark, [*BASE, *ROTATION]), files(spark, sorted(rows, key=lambda r: (r[0], rng.random())))
    for mode in ("fast", "content"):
        assert pairs(trees.identical_trees(a, mode)) == pairs(trees.identical_trees(b, mode))


def test_root_of_everything(spark):
    f = files(spark, [("/", "a/x", 3, 1, "h"), ("/", "a/y", 4, 1, "i"), ("/", "b/x", 3, 1, "h"), ("/", "b/y", 4, 1, "i")])
    assert pairs(trees.identical_trees(f, "content")) == [("/a", "/b")]


def test_overlap_blocks(spark):
    rows = []
    for k in range(35):
        rows += [("/0", f"f{k}", 1000 - k, 1, f"h{k}"), ("/1", f"g{k}", 1000 - k, 1, f"h{k}")]
    rows += [("/0", "p", 50, 1, "p"), ("/2", "p", 50, 1, "p"), *[(r, "q", 40, 1, "q") for r in ("/0", "/1", "/2")]]
    members = groups.members(files(spark, rows))
    items = overlap.items(members, F.col("root"))
    got = sorted((r.col_a, r.col_b, r.block_no, r["items"], r.shared_bytes) for r in overlap.blocks(items).collect())
    assert [(g[:4]) for g in got] == [("/0", "/1", 0, 30), ("/0", "/1", 1, 5)] and got[0][4] == sum(range(971, 1001))
    left = overlap.remaining(members.select("gid").distinct(), items)
    assert sorted(r.gid for r in left.collect()) == ["40:q", "50:p"]
    one = files(spark, [*[("/r", f"{d}/f{k}", 100 * k, 1, f"h{k}") for d in "AB" for k in (1, 2, 3)], ("/r", "A/u", 7, 1, "u"), ("/r", "A/v", 7, 1, "u"), ("/r", "top", 100, 1, "h1")])
    m = groups.members(one)
    from twinfold.functions.paths import virtual_column

    col = virtual_column(F.col("path"), F.col("root"), 1)
    it = overlap.items(m, col)
    assert overlap.blocks(it).first()["items"] == 3 and overlap.unattributed(it, m, col).first().unattributed == 1
    assert overlap.block_files(it, m, col).count() == 6


def test_keep_first_and_glob(spark):
    rows = [(r, "x/f", 5, 1, "h") for r in ("/bk/daily-1", "/bk/monthly-1", "/bk/weekly-1")] + [("/bk/daily-1", "u", 5, 1, "g"), ("/bk/weekly-1", "v", 5, 1, "g")]
    m = groups.members(files(spark, rows))
    kept = {r.gid: r.path for r in queue.keep_first(m).where("action = 'keep'").collect()}
    assert kept == {"5:h": "/bk/monthly-1/x/f", "5:g": "/bk/daily-1/u"}
    gone = lambda g: sorted(r.path for r in queue.by_glob(m, g).where("action = 'dispose'").collect())
    assert gone("*/daily-1/*") == ["/bk/daily-1/u", "/bk/daily-1/x/f"]
    assert gone("*nothing*") == [] and len(gone("*")) == 3
    picked = queue.chosen(m, [0, 1, 2]).groupBy("gid").agg(F.count_if(F.col("action") == "keep").alias("k")).collect()
    assert all(r.k == 1 for r in picked)
    sides = spark.createDataFrame([("/a", "/b"), ("/a", "/ab"), ("/x", "/y")], "dir_a string, dir_b string")
    assert [r.drop for r in queue.glob_side(sides, "dir_a", "dir_b", "/a*").collect()] == ["/a"]


def test_plan_always_leaves_a_copy(spark):
    rng = random.Random(7)
    rows = [(f"/r{rng.randrange(3)}", f"d{rng.randrange(4)}/f{k}", 5, 1, f"h{rng.randrange(9)}") for k in range(60)]
    f = files(spark, rows)
    all_paths = f.select("path")
    for wanted in ({"group": all_paths}, {"tree": all_paths.where("path like '%d1%'"), "overlap": all_paths.where("path like '/r0%'"), "group": queue.keep_first(groups.members(f)).where("action = 'dispose'")}):
        plan = queue.disposal_plan(f, wanted)
        gone = {r.path for r in plan.where("action = 'dispose'").collect()}
        left = {h for r, p, _, _, h in rows if f"{r}/{p}" not in gone}
        assert left == {r[4] for r in rows}
        assert plan.collect() and sorted(map(str, plan.collect())) == sorted(map(str, queue.disposal_plan(f, wanted).collect()))
    with pytest.raises(ValueError):
        queue.disposal_plan(f, {})


def test_moot_actions(spark):
    rows = [("/0", "a", 3, 1, "a"), ("/1", "a", 3, 1, "a"), ("/0", "b", 4, 1, "b"), ("/1", "b", 4, 1, "b")]
    m = groups.members(files(spark, rows))
    it = overlap.items(m, F.col("root"))
    deleted = spark.createDataFrame([("/1/a",)], "path string")
    assert [r.gid for r in queue.live_items(it, overlap.block_files(it, m, F.col("root")), deleted).collect()] == ["4:b"]
    assert {r.gid for r in queue.live_groups(m, deleted).collect()} == {"4:b"}


def test_hash_cascade(spark):
    f = files(spark, [("/r", n, 10, 100, None) for n in "abcdefg"])
    row = lambda n, **k: {"path": f"/r/{n}", "size": 10, "mtime": 100, "inode": 1 + "abcdefg".index(n), "md5": f"cache-{n}", "seen": 900} | k
    cache = spark.createDataFrame([row("a"), row("b", size=9), row("c", inode=99), row("d", seen=10), row("e", seen=5), row("e", md5="new")], hashing.CACHE)
    side = spark.createDataFrame([("/r/a", 10, 100, "side-a"), ("/r/f", 10, 99, "stale"), ("/r/g", 10, 100, "")], "path string, size long, mtime long, md5 string")
    get = lambda **k: {r.relpath: r.md5 for r in hashing.with_known_hashes(f, side, cache, 1000, **k).collect()}
    assert get(max_age=500) == {"a": "side-a", "b": None, "c": None, "d": None, "e": "new", "f": None, "g": None}
    assert get()["d"] == "cache-d"
    assert get(rehash=True) == {"a": "side-a", **dict.fromkeys("bcdefg")}
    assert {r.md5 for r in hashing.with_known_hashes(f, None, None, 1).collect()} == {None}


def test_reports(spark):
    f = files(spark, [("/r", "a", 2048, 1, "h"), ("/r", "b", 2048, 1, "h"), *[("/r", f"c{k}", 3, 1, "i") for k in range(3)]])
    n = groups.nested(groups.members(f))
    text = {r.gid: r.text for r in report.group_columns(n).collect()}
    assert text["2048:h"] == "/r/a  |  /r/b  |  2.0 KB" and text["3:i"] == "# 3 copies, 3 B each\n  /r/c0\n  /r/c1\n  /r/c2"
    assert {r.files for r in report.group_csv(n).collect()} == {"/r/a|/r/b", "/r/c0|/r/c1|/r/c2"}
    assert report.group_simple(n).count() == 7
    assert {r.json for r in report.group_json(n).where("size = 2048").collect()} == {'{"size":2048,"files":["/r/a","/r/b"]}'}
    with pytest.raises(ValueError):
        report.checked("xml")
