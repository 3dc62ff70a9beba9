import json
import os

import pytest
from pyspark.sql import functions as F

from twinfold import run
from twinfold.functions.rules import Rule
from twinfold.operators import groups, hashing
from twinfold.options import parse
from twinfold.plans import effects
from twinfold.sources import cache, sidecars, walk


def put(path, text, mtime=1_700_000_000):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (mtime, mtime))


def rel(df):
    return sorted(r.relpath for r in df.where("accepted").collect())


def test_walk(spark, tmp_path):
    root = tmp_path / "r"
    for p in ("a", ".hidden/x", "_u", "d/e/f.tmp", "d/e/keep", "d/g", "with\nnewline", f"d/g{sidecars.SUFFIX}", sidecars.SUFFIX):
        put(root / p, p)
    os.symlink(root / "a", root / "link")
    os.mkfifo(root / "pipe")
    assert rel(walk.read(spark, [str(root)])) == sorted([".hidden/x", sidecars.SUFFIX, "_u", "a", "d/e/f.tmp", "d/e/keep", "d/g", "with\nnewline"])
    assert "d/e/keep" not in rel(walk.read(spark, [str(root)], [Rule("/d/e", True), Rule("keep", False)]))
    assert rel(walk.read(spark, [str(root)], [Rule("*.tmp", True)])).count("d/e/f.tmp") == 0
    got = walk.read(spark, [str(root)], [Rule("*.tmp", True)])
    assert got.where("not accepted").count() == 1
    assert "d/g" not in rel(walk.read(spark, [str(root)], recursive=False))
    assert rel(walk.read(spark, [str(root)], min_size=9)) == ["d/e/f.tmp", "with\nnewline"] or "d/e/f.tmp" in rel(walk.read(spark, [str(root)], min_size=9))
    two = walk.read(spark, [str(root), str(root / "d")]).where("accepted")
    assert {(r.source, r.relpath) for r in two.collect() if r.path.endswith("/d/g")} == {(1, "g")}
    assert walk.read(spark, [str(tmp_path / "none")]).where("error is not null").count() == 1
    assert walk.root_list(["/a", "/a/", "/b"]) == ["/a", "/b"]


def test_one_deep_directory_is_split(spark, tmp_path):
    root = tmp_path / "r"
    for k in range(30):
        put(root / f"a/b/{k}/f.tmp", str(k))
        put(root / f"a/b/{k}/deep/g", str(k))
    put(root / "a/x", "x")
    put(root / "a/c/d/e/f/h", "h")
    every = [f"a/b/{k}/{n}" for k in range(30) for n in ("f.tmp", "deep/g")] + ["a/x", "a/c/d/e/f/h"]
    assert len(walk.WalkReader({"roots": json.dumps([str(root)])}).partitions()) >= 30
    assert rel(walk.read(spark, [str(root)])) == sorted(every)
    assert rel(walk.read(spark, [str(root)], [Rule("/a/b", True)])) == ["a/c/d/e/f/h", "a/x"]
    hidden = walk.read(spark, [str(root)], [Rule("/a/b", True)]).where("not accepted")
    assert hidden.count() == 60
    assert rel(walk.read(spark, [str(root)], recursive=False)) == []
    inner = walk.read(spark, [str(root), str(root / "a/b/3")])
    assert sorted(r.path for r in inner.where("source = 1").collect()) == [str(root / "a/b/3" / n) for n in ("deep/g", "f.tmp")] and inner.count() == 62


def test_links_and_hashes(spark, tmp_path):
    put(tmp_path / "r/a", "same")
    os.link(tmp_path / "r/a", tmp_path / "r/b")
    put(tmp_path / "r/c", "same")
    f = groups.first_of_inode(walk.read(spark, [str(tmp_path / "r")]).where("accepted"))
    assert sorted(r.relpath for r in f.collect()) == ["a", "c"]
    rows = f.withColumn("path", F.when(F.col("relpath") == "c", F.concat("path", F.lit("-gone"))).otherwise(F.col("path")))
    got = {r.relpath: r for r in hashing.read_hashes(rows, 2).collect()}
    assert got["a"].md5 == "51037a4a37730f52c8732586d3aaa316" and got["c"].md5 is None and got["c"].hash_error


def test_copy_sidecar_and_trust(spark, tmp_path):
    put(tmp_path / "src/a/b.bin", "0123456789abcdefghij")
    got = effects.copy_tree(spark, str(tmp_path / "src"), str(tmp_path / "dst"), 2, chunk=8, full=True).collect()
    assert [r.error for r in got] == [None]
    target = tmp_path / "dst/a/b.bin"
    facts = json.loads((tmp_path / f"dst/a/b.bin{sidecars.SUFFIX}").read_text())
    assert len(facts["chunk_md5"]) == 3 and int(target.stat().st_mtime) == 1_700_000_000
    side = sidecars.read(spark, str(tmp_path / "dst"))
    assert side.select("path", "md5").first() == (str(target), facts["md5"])
    marked = side.withColumn("md5", F.lit("trusted"))
    f = walk.read(spark, [str(tmp_path / "dst")]).where("accepted")
    assert hashing.resolve(f, marked, None, 0).first().md5 == "trusted"
    os.utime(target, (1, 1))
    assert hashing.resolve(f, marked, None, 0).first().md5 == facts["md5"]
    with pytest.raises(OSError):
        effects.copy_file(str(target), str(target))


def test_sidecars_of_hidden_files(spark, tmp_path):
    for n in (".hidden/.x", "_u", "a+b %41"):
        put(tmp_path / "r" / n, n)
        (tmp_path / f"r/{n}{sidecars.SUFFIX}").write_text(sidecars.json_text({"size": len(n), "mtime": 1_700_000_000, "md5": n, "media": None}))
    (tmp_path / f"r/broken{sidecars.SUFFIX}").write_bytes(b"\xff{")
    got = {r.path: r.md5 for r in sidecars.read(spark, str(tmp_path / "r")).collect()}
    assert got == {str(tmp_path / "r" / n): n for n in (".hidden/.x", "_u", "a+b %41")}


def test_copy_command_leaves_media_facts(tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\x08\x02\0\0\0" + bytes(4)
    (tmp_path / "src/d").mkdir(parents=True)
    (tmp_path / "src/d/p.png").write_bytes(png)
    put(tmp_path / "src/plain", "no picture")
    assert run.main(["copy", str(tmp_path / "src"), str(tmp_path / "dst"), "--transfers", "2", "--full"]) == 0
    facts = json.loads((tmp_path / f"dst/d/p.png{sidecars.SUFFIX}").read_text())
    assert (facts["media"]["width"], facts["media"]["height"]) == (640, 480) and facts["size"] == len(png)
    assert "media" not in json.loads((tmp_path / f"dst/plain{sidecars.SUFFIX}").read_text())
    assert (tmp_path / "dst/d/p.png").read_bytes() == png


def test_read_back(tmp_path):
    put(tmp_path / "f", "0123456789")
    good = [hashing.hashlib.md5(x).hexdigest() for x in (b"0123", b"4567", b"89")]
    effects.read_back(str(tmp_path / "f"), good, 4, True)
    effects.read_back(str(tmp_path / "f"), ["bad", *good[1:]], 4, False)
    for bad in (["bad", *good[1:]], [*good[:2], "bad"]):
        with pytest.raises(OSError):
            effects.read_back(str(tmp_path / "f"), bad, 4, True)


def test_trash(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_DATA_HOME", str(tmp_path / "data"))
    for d in ("x", "y"):
        put(tmp_path / d / "same name", d)
    a, b = (effects.trash(str(tmp_path / d / "same name"), home=str(tmp_path)) for d in ("x", "y"))
    assert a != b and open(a).read() == "x" and open(b).read() == "y"
    record = (tmp_path / "data/Trash/info/same name.1.trashinfo").read_text()
    assert record.startswith("[Trash Info]\nPath=") and "same%20name\nDeletionDate=" in record
    with pytest.raises(OSError):
        effects.trash(str(tmp_path / "x" / "missing"), home=str(tmp_path))
    assert not (tmp_path / "data/Trash/info/missing.trashinfo").exists()
    assert effects.mount_point("/") == "/"


def test_dispose_and_prune(spark, tmp_path):
    for n in "abc":
        put(tmp_path / "r" / n / "f", "same")
    plan = spark.createDataFrame([(str(tmp_path / "r/a/f"), 4, "keep", "content"), (str(tmp_path / "r/b/f"), 4, "dispose", "content"), (str(tmp_path / "r/c/f"), 4, "dispose", "size and mtime")], "path string, size long, action string, evidence string")
    assert effects.dispose(plan)["files"] == 1 and (tmp_path / "r/b/f").exists()
    assert effects.dispose(plan, "unlink") == {"files": 1, "bytes": 4, "failed": 0, "refused": 1}
    assert not (tmp_path / "r/b/f").exists() and (tmp_path / "r/c/f").exists()
    assert effects.prune_empty([str(tmp_path / "r")]) == [str(tmp_path / "r/b")]
    with pytest.raises(ValueError):
        effects.dispose(plan, "burn")


@pytest.mark.parametrize("checksum", [False, True])
def test_whole_run(spark, tmp_path, checksum):
    for r in ("daily-1", "weekly-1"):
        put(tmp_path / r / "tree/x", "content of x")
        put(tmp_path / r / "tree/y", "content of yy")
        put(tmp_path / r / f"own-{r}", f"text {r}")
    put(tmp_path / "daily-1/loose", "loose text!!")
    put(tmp_path / "weekly-1/deep/er/loose2", "loose text!!")
    o = parse([str(tmp_path / "daily-1"), str(tmp_path / "weekly-1"), "--cache", str(tmp_path / "cache"), *["--checksum"] * checksum])
    assert o.cross_root
    got = run.analyse(spark, o, now=1000)
    assert [(r.dir_a, r.dir_b) for r in got["trees"].collect()] == [(str(tmp_path / "daily-1/tree"), str(tmp_path / "weekly-1/tree"))]
    plan = {os.path.relpath(r.path, tmp_path): r.action for r in got["plan"].collect()}
    assert {p for p, a in plan.items() if a == "dispose"} >= {"daily-1/tree/x", "daily-1/tree/y"}
    assert not any(plan.get(p) == "dispose" for p in ("weekly-1/tree/x", "own-daily-1"))
    if checksum:
        assert cache.read(spark, str(tmp_path / "cache")).count() >= 6
        again = run.analyse(spark, o, now=2000)
        assert again["groups"].count() == got["groups"].count()
        cache.compact(spark, str(tmp_path / "cache"), str(tmp_path / "compact"))
        assert cache.read(spark, str(tmp_path / "compact")).groupBy("path").count().where("count > 1").isEmpty()


def test_main_writes_reports(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path / "own cache"))
    for n in "ab":
        put(tmp_path / "r" / n, "twice")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert run.main([str(tmp_path / "r"), "--checksum", "--format", "csv", "--out", str(tmp_path / "out")]) == 0
    assert "size_bytes" in "".join(p.read_text() for p in (tmp_path / "out/groups").glob("*.csv"))
    assert cache.read(spark, cache.default_folder()).count() == 2
    assert run.main([str(tmp_path / "r"), "--delete"]) == 0 and "refused" in capsys.readouterr().out
    assert run.main([str(tmp_path / "r"), str(tmp_path / "none"), "--within-root", "--verbose"]) == 0
    seen = capsys.readouterr()
    assert "none" in seen.err and "files: 2" in seen.out
    assert run.main([str(tmp_path / "none"), "--quiet"]) == 0 and "none" not in capsys.readouterr().err


def test_disposed_trees_leave_no_empty_directories(spark, tmp_path):
    for d in ("p/tree", "q/tree"):
        for n in ("x/1", "x/2", "y"):
            put(tmp_path / "r" / d / n, f"content of {n}")
    args = [str(tmp_path / "r"), "--checksum", "--no-cache", "--no-overlap", "--dispose", "unlink", "--delete"]
    assert run.main(args) == 0
    left = sorted(str(p.relative_to(tmp_path / "r")) for p in (tmp_path / "r").rglob("*") if p.is_file())
    assert len(left) == 3 and len({p.split("/")[0] for p in left}) == 1
    gone = ({"p", "q"} - {left[0].split("/")[0]}).pop()
    assert not any((tmp_path / "r" / gone).rglob("*"))


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from twinfold.lineage import shared_dir

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
