import itertools

import pytest
from pyspark.sql import functions as F

from twinfold.functions import globs, media, paths, rules, scalars


def column(spark, expr, values, kind="string"):
    rows = [(k, v) for k, v in enumerate(values)]
    got = spark.createDataFrame(rows, f"k int, v {kind}").select("k", expr(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(got, key=lambda r: r.k)]


GLOBS = [
    ("*.txt", "a.txt", True), ("*.txt", "a/b.txt", False), ("?", "é", True), ("?", "/", False), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("[^a]", "b", True),
    ("[", "[", False), ("[]a]", "]", False), ("[-a]", "a", False), ("[a", "a", False), ("a\\*b", "a*b", True), ("a\\", "a", False), ("[\\]]", "]", True), ("[b-a]", "a", False),
    ("**", "a/b/c", True), ("a/**", "a", True), ("a/**", "a/b/c", True), ("a/**", "ab", False), ("foo**", "foobar", False), ("foo**", "foo/bar", True),
    ("**/x", "x", True), ("**/x", "a/b/x", True), ("**/x", "a/bx", False), ("a/**/b", "a/b", True), ("a/**/b", "a/x/b", False), ("a/**/**/b", "a/x/y/b", True), ("**/*.txt", "d/e.txt", True),
    ("a/**/*", "a", True), ("a.b", "axb", False), ("a\nb", "a\nb", True), ("*", "a\nb", True), ("a", "a\n", False), ("(x)+", "(x)+", True),
]


@pytest.mark.parametrize("pattern,path,want", GLOBS)
def test_path_globs(pattern, path, want):
    regex = globs.path_regex(pattern)
    assert (regex is not None and globs.python_match(regex, path)) is want


def test_path_globs_in_spark(spark):
    for pattern, path, want in GLOBS:
        regex = globs.path_regex(pattern)
        if regex is not None:
            assert column(spark, lambda v: v.rlike(regex), [path]) == [want], (pattern, path)  # noqa: B023


def test_removal_globs(spark):
    for glob, path, want in [("*.jpg", "/a/b.jpg", True), ("*.jpg", "/a/b.jpeg", False), ("/a/?.x", "/a/b.x", True), ("/a?b", "/a/b", True), ("*", "a\nb", False), ("*", "a\rb", True), ("a", "a\n", False), ("[a]", "[a]", True), ("/bk/*-1/*", "/bk/daily-1/x/y", True)]:
        assert globs.python_match(globs.removal_regex(glob), path) is want
        assert column(spark, lambda v: v.rlike(globs.removal_regex(glob)), [path]) == [want]  # noqa: B023


def test_rules(spark):
    text = "# note\n\n- *.tmp\n+ keep.tmp\n/top\nsub/dir/\n"
    own = rules.parse_rules(text, True)
    assert own == [rules.Rule("*.tmp", True), rules.Rule("keep.tmp", False), rules.Rule("/top", True), rules.Rule("sub/dir/", True)]
    cases = {"a.tmp": True, "x/a.tmp": True, "keep.tmp": False, "x/keep.tmp": False, "top": True, "x/top": False, "top/below": True, "sub/dir": True, "sub/dir/f": True, "x/sub/dir": False, "a.tmp/keep.tmp": True, "plain": False}
    assert column(spark, lambda v: rules.pruned(own, v), cases) == list(cases.values())
    for path, want in cases.items():
        above = ["/".join(path.split("/")[:k]) for k in range(1, path.count("/") + 2)]
        assert any(rules.excluded_path(own, p) for p in above) is want
    assert rules.rule_list(include=["a"], exclude=["b"]) == [rules.Rule(rules.BUILT_IN_EXCLUDE, True), rules.Rule("a", False), rules.Rule("b", True)]
    assert rules.excluded_path(rules.rule_list(include=["x"], exclude=["x"]), "x") and not rules.excluded_path([], "x")
    assert not rules.Rule("/", True).matches("a") and not rules.Rule("[", True).matches("[")


def test_paths(spark):
    assert column(spark, paths.parent, ["/a/b", "/a", "a/b", "a"]) == ["/a", "/", "a", ""]
    assert column(spark, paths.proper_ancestors, ["a/b/c", "a"]) == [["a", "a/b"], []]
    assert column(spark, lambda v: paths.directories(F.lit("/r"), v), ["a/b/c", "x"]) == [["/r", "/r/a", "/r/a/b"], ["/r"]]
    assert column(spark, lambda v: paths.directories(F.lit("/"), v), ["a/x"]) == [["/", "/a"]]
    assert column(spark, lambda v: paths.ancestors_or_self(F.lit("/r"), v), ["/r", "/r/a/b"]) == [["/r"], ["/r", "/r/a", "/r/a/b"]]
    assert column(spark, lambda v: paths.is_below(F.lit("/a"), v), ["/a", "/a/b", "/ab", "/"]) == [False, True, False, False]
    assert column(spark, lambda v: paths.is_below(F.lit("/"), v), ["/", "/b"]) == [False, True]
    cases = [("/bk/2024-01/a/x", "/bk", 1, "/bk/2024-01"), ("/bk/x", "/bk", 1, ""), ("/other/x/y", "/bk", 1, ""), ("/bk/a/b/c", "/bk", 2, "/bk/a/b"), ("/bk/a/b", "/bk", 2, ""), ("/bk/a/b", "/bk", 0, "/bk/a")]
    for path, root, depth, want in cases:
        assert column(spark, lambda v: paths.virtual_column(v, F.lit(root), depth), [path]) == [want]  # noqa: B023
    assert column(spark, lambda v: paths.innermost(v, ["/", "/a/b", "/a"]), ["/a/b/c", "/a/x", "/z"]) == ["/a/b", "/a", "/"]
    assert column(spark, lambda v: paths.truncated_left(v, 4), ["abcd", "abcde"]) == ["abcd", "…cde"]
    assert column(spark, lambda v: paths.below(v, "/a"), ["/a/x", "/a", "/a0", "/a.b/x"]) == [True, False, False, False]
    assert column(spark, lambda v: paths.display(v, F.lit("/r"), F.lit(3)), ["/r/x"]) == ["x (+2)"]
    odd = ["/a b/c+d", "/ü/~x", "/$&+:=@/", "/*(!)'", "plain"]
    assert column(spark, paths.encoded_column, odd) == [paths.encoded(p) for p in odd]
    assert paths.encoded("/a b/c") == "/a%20b/c"


def test_walk_order(spark):
    rows = ["a.txt", "a/b", "a", "a/b/c"]
    got = spark.createDataFrame([(r,) for r in rows], "v string").orderBy(paths.walk_key(F.col("v"))).collect()
    assert [r.v for r in got] == ["a", "a/b", "a/b/c", "a.txt"]


def test_sizes(spark):
    cases = {"": 0, "100": 100, "1k": 1024, "1.5M": 1572864, "2G": 2 << 30, "1T": 1 << 40, " 3 K ": 3072, ".5k": 512}
    assert [scalars.parse_size(t) for t in cases] == list(cases.values())
    assert column(spark, scalars.size_of, cases) == list(cases.values())
    for bad in ("x", "1q", "-1", "k", "nan", "inf"):
        with pytest.raises(ValueError):
            scalars.parse_size(bad)
    assert column(spark, scalars.size_of, ["x", "1q", "-1"]) == [None] * 3
    sizes = {-1: "?", 0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB", 1792: "1.8 KB", 1048575: "1024.0 KB", 1 << 20: "1.0 MB", 5 << 40: "5.0 TB", 1 << 60: "1.0 EB"}
    assert column(spark, scalars.human_size, sizes, "long") == list(sizes.values())
    assert [scalars.format_size(s) for s in sizes] == list(sizes.values())


def test_durations_and_indices():
    assert [scalars.parse_duration(t) for t in ("", "0", "30d", "1h30m", "90s", "1.5h")] == [0, 0, 2592000, 5400, 90, 5400]
    for bad in ("x", "1", "1dd", "d"):
        with pytest.raises(ValueError):
            scalars.parse_duration(bad)
    assert scalars.parse_indices("1,3-5 3", 5) == [0, 2, 3, 4]
    assert [scalars.parse_indices(t, 5) for t in ("0", "6", "a", "4-2", "")] == [None] * 5


def test_cadence(spark):
    p = ["/bk/daily-1/x", "/bk/Weekly/x", "/monthly-04-april", "/q/quarterly-2026/a/b", "/daily_1/x", "/x", "/daily/monthly/z"]
    assert column(spark, scalars.cadence_rank, p) == [0, 1, 2, 3, None, None, 0]
    assert column(spark, scalars.cadence_tail, p)[:4] == ["/x", "/x", "", "/a/b"]
    pairs = [("/bk/daily-1/x", "/bk/monthly-1/x", True), ("/bk/monthly-1/x", "/bk/daily-1/x", False), ("/a/daily/x", "/b/weekly/x", False), ("/bk/daily/x", "/bk/weekly/y", False), ("/p", "/q", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, want boolean").select("want", scalars.swaps(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_media(spark):
    video = '{"streams": [{"codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080, "avg_frame_rate": "25/1", "tags": {"creation_time": "2024"}}], "format": {"duration": "12.5", "format_name": "mov"}}'
    got = column(spark, media.media_facts, [video, "{}", "not json", '{"streams": [{"codec_type": "audio", "duration": "3"}]}', '{"format": {"duration": "bad", "tags": {"DateTimeOriginal": "T"}}}'])
    assert (got[0].width, got[0].height, got[0].duration_sec, got[0].codec, got[0].frame_rate, got[0].capture_time, got[0].format_name) == (1920, 1080, 12.5, "h264", "25/1", "2024", "mov")
    assert got[1] is None and got[2] is None and got[3].duration_sec == 3 and got[3].width is None and got[4].capture_time == "T"


def test_image_headers():
    assert media.image_size(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x07\0\0\0\x09" + b"\0" * 9) == (7, 9)
    assert media.image_size(b"GIF89a\x05\0\x06\0") == (5, 6)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01"
    assert media.image_size(jpeg) == (32, 16)
    assert all(media.image_size(jpeg[:k]) is None for k in range(len(jpeg) - 4)) and media.image_size(b"text") is None


def test_globs_survive_any_pattern():
    for p in map("".join, itertools.product("a*[]^-\\/", repeat=4)):
        regex = globs.path_regex(p)
        if regex:
            globs.python_match(regex, "a/b-a]")
