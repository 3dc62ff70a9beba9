"""The registered queries of the duplicate engine, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .functions import globs, media, paths, rules, scalars
from .lineage import cut
from .operators import groups, hashing, overlap, trees
from .plans import queue, report
from .sources import sidecars
from .streaming import dedup


def _docs(spark, d):
    return catalog.documents_as_files(catalog.table(spark, d, "documents"))


def _bk(spark, d):
    return catalog.backup_rotation(catalog.table(spark, d, "documents"))


def _held(spark, d):
    """The rotation's files, written once: what is made of them several times reads no text."""
    return cut(_bk(spark, d))


# --- SQL pieces -----------------------------------------------------------------

_FILES = """files as (
  select '/corpus/' || rel as path, rel as relpath, '/corpus' as root, octet_length(encode(t))::bigint as size,
         n_chars as mtime, doc_id as inode, cast(substr(source, 4) as integer) as source, md5(t) as md5
  from (select *, coalesce(text, '') as t, concat_ws('/', source, lang, doc_id || '.txt') as rel from documents))"""
_BK = f"""{_FILES}, bk as (
  select root || '/' || rel as path, rel as relpath, root, size, mtime, inode, source, md5 from (
    select r.root, r.source, f.size, f.mtime, f.inode, f.md5,
           case when substr(f.md5, 1, 2) in ('0' || r.source, '8' || r.source) then 'moved/' || f.relpath else f.relpath end as rel
    from files f, (values ('/bk/daily-1', 0), ('/bk/weekly-1', 1), ('/bk/monthly-1', 2)) r(root, source)))"""
#: Each file in each directory above it, with the path below that directory.
_TREE = f"""{_BK}, parts as (select *, string_split(relpath, '/') as p from bk), ind as (
  select *, substr(path, length(dir) + 2) as entry from (
    select path, root, size, mtime, md5, source, case when k = 0 then root else root || '/' || array_to_string(p[1:k], '/') end as dir
    from (select *, unnest(range(0, len(p))) as k from parts)))"""


def _tree_pairs(key: str) -> str:
    return f"""{_TREE}, prints as (
  select dir, root, count(*) as n, sum(size)::bigint as bytes, md5(string_agg(entry || chr(9) || size || chr(9) || {key}, chr(10) order by entry)) as fp from ind group by dir, root),
pairs as (select a.dir as dir_a, a.root as root_a, b.dir as dir_b, b.root as root_b, a.n as file_count, a.bytes as total_size
  from prints a join prints b on a.fp = b.fp and a.n = b.n and a.dir < b.dir where a.n >= 2
  and not starts_with(b.dir, a.dir || '/') and not starts_with(a.dir, b.dir || '/'))"""


_UNDOMINATED = """, best as (select * from pairs p where not exists (select 1 from pairs q where (q.dir_a <> p.dir_a or q.dir_b <> p.dir_b) and (
  (starts_with(p.dir_a || '/', q.dir_a || '/') and starts_with(p.dir_b || '/', q.dir_b || '/')) or
  (starts_with(p.dir_a || '/', q.dir_b || '/') and starts_with(p.dir_b || '/', q.dir_a || '/')))))"""


def _members(table: str, cross: bool = False) -> str:
    extra = " and min(source) <> max(source)" if cross else ""
    return f"""mem as (select f.*, f.size || ':' || f.md5 as gid, g.n from {table} f join
  (select size, md5, count(*) as n from {table} group by size, md5 having count(*) > 1{extra}) g on f.size = g.size and f.md5 = g.md5)"""


_BLOCKS = """, two as (select gid, size, min(root) as col_a, max(root) as col_b from mem group by gid, size having count(distinct root) = 2),
items as (select *, (row_number() over (partition by col_a, col_b order by size desc, gid) - 1) // 30 as block_no
  from (select *, count(*) over (partition by col_a, col_b) as shared from two) where shared >= 2)"""
_CADENCE = r"'^((?s:.*?))\b(daily|weekly|monthly|quarterly)\b[^/]*(/(?s:.*))?$'"


def _rank(path: str) -> str:
    return f"(case lower(regexp_extract({path}, {_CADENCE}, 2, 'i')) when 'daily' then 0 when 'weekly' then 1 when 'monthly' then 2 when 'quarterly' then 3 end)"


def _swap(a: str, b: str) -> str:
    part = lambda p, k: f"regexp_extract({p}, {_CADENCE}, {k}, 'i')"
    return f"coalesce({part(a, 1)} = {part(b, 1)} and {part(a, 3)} = {part(b, 3)} and {_rank(a)} < {_rank(b)}, false)"


def _human(size: str) -> str:
    cases = "".join(f" when {size} < {1024 ** (k + 1)} then printf('%.1f', {size} / {1024.0**k}) || ' {u}B'" for k, u in enumerate("KMGTP", 1))
    return f"case when {size} < 0 then '?' when {size} < 1024 then {size} || ' B'{cases} else printf('%.1f', {size} / {1024.0**6}) || ' EB' end"


#: The preferred copy of each group first.
_RANKED = f""", ctx as (select gid, count({_rank('path')}) = count(*) and min(regexp_extract(path, {_CADENCE}, 1, 'i')) = max(regexp_extract(path, {_CADENCE}, 1, 'i'))
    and min(regexp_extract(path, {_CADENCE}, 3, 'i')) = max(regexp_extract(path, {_CADENCE}, 3, 'i')) as same from mem group by gid),
ranked as (select mem.*, row_number() over (partition by gid order by case when same then -{_rank('path')} else 0 end, source, string_split(path, '/')) as k, count(*) over (partition by gid) as n_all
  from mem join ctx using (gid))"""

# --- files and groups -----------------------------------------------------------------

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@_query("collision_sizes", f"with {_FILES} select size, count(*) as n from files group by size having count(*) > 1")
def collision_sizes(spark: SparkSession, d: str) -> DataFrame:
    return groups.collision_sizes(_docs(spark, d)).select("size", "n")


@_query("candidate_files", f"with {_FILES} select path, size from files where size in (select size from files group by size having count(*) > 1)")
def candidate_files(spark, d):
    return groups.candidates(_docs(spark, d)).select("path", "size")


@_query("dup_groups_fast", f"with {_FILES} select size, mtime, count(*) as n, size * (count(*) - 1) as wasted, min(path) as first_path from files group by size, mtime having count(*) > 1")
def dup_groups_fast(spark, d):
    return groups.groups(_docs(spark, d), groups.FAST).select("size", "mtime", "n", "wasted", "first_path")


@_query("dup_groups_md5", f"with {_FILES} select size, md5, count(*) as n, size * (count(*) - 1) as wasted, min(path) as first_path from files group by size, md5 having count(*) > 1")
def dup_groups_md5(spark, d):
    return groups.groups(_docs(spark, d)).select("size", "md5", "n", "wasted", "first_path")


@_query("dup_groups_cross_root", f"with {_FILES} select size, md5, count(*) as n, size * (count(*) - 1) as wasted from files group by size, md5 having count(*) > 1 and count(distinct source) > 1")
def dup_groups_cross_root(spark, d):
    return groups.groups(_docs(spark, d), cross_root=True).select("size", "md5", "n", "wasted")


@_query("reclaimable_total", f"with {_FILES} select count(*) as groups, sum(n)::bigint as files, sum(wasted)::bigint as wasted from (select count(*) as n, size * (count(*) - 1) as wasted from files group by size, md5 having count(*) > 1)")
def reclaimable_total(spark, d):
    return groups.reclaimable(groups.groups(_docs(spark, d)))


@_query("files_per_root", f"with {_FILES} select source, count(*) as n, sum(size)::bigint as bytes from files group by source")
def files_per_root(spark, d):
    return groups.files_per_root(_docs(spark, d))


@_query("collision_progress", f"with {_FILES} select size, n, (sum(size * n) over (order by size desc))::bigint as done_bytes from (select size, count(*) as n from files group by size having count(*) > 1)")
def collision_progress(spark, d):
    return groups.progress(groups.collision_sizes(_docs(spark, d)).select("size", "n"))


@_query("size_filter", f"with {_FILES} select path, size from files where size between 1024 and 8192")
def size_filter(spark, d):
    low, high = scalars.parse_size("1k"), scalars.parse_size("8K")
    return _docs(spark, d).where(F.col("size").between(low, high)).select("path", "size")


@_query("hardlink_dedup", f"with {_BK} select path, source from (select path, source, row_number() over (partition by inode order by source, string_split(path, '/')) as k from bk where inode <> 0) where k = 1 union all select path, source from bk where inode = 0")
def hardlink_dedup(spark, d):
    return groups.first_of_inode(_bk(spark, d)).select("path", "source")


@_query("skip_set", f"with {_FILES} select path from files where path not in (select max(path) from files group by size, md5 having count(*) > 1)")
def skip_set(spark, d):
    files = _docs(spark, d)
    last = files.groupBy("size", "md5").agg(F.max("path").alias("path"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.without(files, last).select("path")


@_query("stamped_roots", f"with {_FILES} select path, '/even' as root, 0 as source from files where size % 2 = 0 union all select path, '/odd', 1 from files where size % 2 = 1")
def stamped_roots(spark, d):
    """The files of two roots as one table, each with its root and the root's place."""
    files = _docs(spark, d).select("path", "size")
    return catalog.with_roots({"/even": files.where("size % 2 = 0"), "/odd": files.where("size % 2 = 1")}).select("path", "root", "source")


@_query("sidecar_names", f"""with {_FILES} select path, path || '{sidecars.SUFFIX}' as sidecar, true as is_one, false as file_is_one from files""")
def sidecar_names(spark, d):
    side = sidecars.sidecar_path(F.col("path"))
    return _docs(spark, d).select("path", side.alias("sidecar"), sidecars.is_sidecar_column(side).alias("is_one"), sidecars.is_sidecar_column(F.col("path")).alias("file_is_one"))


@_query("relative_names", f"with {_FILES} select size, md5, substr(min(path), 9) || ' (+' || (count(*) - 1) || ')' as shown from files group by size, md5 having count(*) > 1")
def relative_names(spark, d):
    """The first copy of each group below its root, and how many more there are."""
    return groups.groups(_docs(spark, d)).select("size", "md5", paths.display(F.col("first_path"), F.lit("/corpus"), F.col("n")).alias("shown"))


# --- paths, rules, scalars ------------------------------------------------------------


@_query("files_under_dir", f"with {_FILES} select path, size from files where starts_with(path, '/corpus/src1/')")
def files_under_dir(spark, d):
    return _docs(spark, d).where(paths.below(F.col("path"), "/corpus/src1")).select("path", "size")


@_query("walk_order", f"with {_FILES} select path, row_number() over (partition by source order by string_split(path, '/')) as place from files")
def walk_order(spark, d):
    return groups.walk_places(_docs(spark, d).select("path", "source")).select("path", "place")


@_query("innermost_root", f"""with {_FILES} select path, case when starts_with(path, '/corpus/src2/en/') then '/corpus/src2/en'
  when starts_with(path, '/corpus/src2/') then '/corpus/src2' when starts_with(path, '/corpus/') then '/corpus' end as owner from files""")
def innermost_root(spark, d):
    return _docs(spark, d).select("path", paths.innermost(F.col("path"), ["/corpus", "/corpus/src2/en", "/corpus/src2"]).alias("owner"))


@_query("virtual_columns", f"with {_BK} select path, case when len(string_split(relpath, '/')) > 2 then root || '/' || array_to_string(string_split(relpath, '/')[1:2], '/') else '' end as col from bk")
def virtual_columns(spark, d):
    return _bk(spark, d).select("path", paths.virtual_column(F.col("path"), F.col("root"), 2).alias("col"))


@_query("human_size", f"with {_FILES} select path, size, {_human('size')} as human, {_human('size * 1048577')} as human_large from files")
def human_size(spark, d):
    return _docs(spark, d).select("path", "size", scalars.human_size(F.col("size")).alias("human"), scalars.human_size(F.col("size") * 1048577).alias("human_large"))


@_query("parsed_sizes", "select doc_id, case doc_id % 4 when 0 then n_chars when 1 then n_chars * 1024 when 2 then n_chars * 1048576 + 524288 else n_chars * 1073741824 end as bytes from documents")
def parsed_sizes(spark, d):
    n = F.col("n_chars").cast("string")
    text = F.element_at(F.array(n, F.concat(n, F.lit("k")), F.concat(n, F.lit(".5M")), F.concat(n, F.lit(" g"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return catalog.table(spark, d, "documents").select("doc_id", scalars.size_of(text).alias("bytes"))


@_query("cadence_rank", f"with {_BK} select path, {_rank('path')}::integer as rank, regexp_extract(path, {_CADENCE}, 1, 'i') as prefix, regexp_extract(path, {_CADENCE}, 3, 'i') as tail from bk")
def cadence_rank(spark, d):
    p = F.col("path")
    return _bk(spark, d).select("path", scalars.cadence_rank(p).alias("rank"), scalars.cadence_prefix(p).alias("prefix"), scalars.cadence_tail(p).alias("tail"))


@_query("short_paths", f"with {_FILES} select path, case when length(path) > 20 then '…' || right(path, 19) else path end as shown from files")
def short_paths(spark, d):
    return _docs(spark, d).select("path", paths.truncated_left(F.col("path"), 20).alias("shown"))


@_query("encoded_paths", "select page_id, replace(replace(url, '://', '/'), ' ', '%20') as encoded from (select page_id, regexp_replace(regexp_replace(url, '[?#].*', ''), '^(https?)://', '\\1 ') as url from pages)")
def encoded_paths(spark, d):
    url = F.regexp_replace(F.regexp_replace("url", r"[?#].*", ""), "^(https?)://", "$1 ")
    return catalog.table(spark, d, "pages").select("page_id", paths.encoded_column(url).alias("encoded"))


#: Rules of the registered query: a later rule beats an earlier one.
RULES = [rules.Rule(".twinfold", True), rules.Rule("src1*", True), rules.Rule("/src1[2-4]/en", False), rules.Rule("*/de/", True), rules.Rule("**/fr/*7.txt", True), rules.Rule("src9/**", False)]
_HIDDEN = """case when regexp_full_match(p, 'src9(/.*)?') then false when regexp_full_match(p, '([^/]*/)*fr/[^/]*7\\.txt') then true
  when regexp_full_match(p, '[^/]*/de') then true when regexp_full_match(p, 'src1[2-4]/en') then false
  when regexp_full_match(p, '([^/]*/)*src1[^/]*(/.*)?') then true when regexp_full_match(p, '([^/]*/)*\\.twinfold(/.*)?') then true else false end"""


@_query("rule_filter", f"""with {_FILES}, each as (select path, unnest([array_to_string(s[1:k], '/') for k in range(1, len(s) + 1)]) as p from (select path, string_split(relpath, '/') as s from files))
  select path, bool_or({_HIDDEN}) as hidden from each group by path""")
def rule_filter(spark, d):
    return _docs(spark, d).select("path", rules.pruned(RULES, F.col("relpath")).alias("hidden"))


@_query("page_rules", """select page_id, regexp_full_match(p, '([^/]*/)*[^/]*\\.html?') or regexp_full_match(p, '[^/]*/a[^/]*') as hidden from
  (select page_id, rtrim(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '[?#].*', ''), '/') as p from pages)""")
def page_rules(spark, d):
    own = [rules.Rule("**/*.html", True), rules.Rule("**/*.htm", True), rules.Rule("*/a*", True)]
    return catalog.pages_as_paths(catalog.table(spark, d, "pages")).select("page_id", rules.excluded(own, F.col("relpath")).alias("hidden"))


@_query("removal_glob", f"with {_BK} select path, regexp_full_match(path, '/bk/.*-1/.*src1.?/.*\\.txt') as hit from bk")
def removal_glob(spark, d):
    return _bk(spark, d).select("path", F.col("path").rlike(globs.removal_regex("/bk/*-1/*src1?/*.txt")).alias("hit"))


SQL["removal_glob"] = f"with {_BK} select path, regexp_full_match(path, '/bk/.*-1/.*src1./.*\\.txt') as hit from bk"

# --- hash cascade -------------------------------------------------------------------------

_NOW = 1_000_000


@_query("hash_cascade", f"""with {_FILES} select path, case when source < 5 and mtime > 500 then 'sidecar' when source < 12 and size > 1000 and 1000000 - inode <= 999800 then 'cache' end as hash_origin,
  case when source < 5 and mtime > 500 then md5 when source < 12 and size > 1000 and 1000000 - inode <= 999800 then 'c' || md5 end as md5 from files""")
def hash_cascade(spark, d):
    """Sidecars (stale below 500) for sources below 5, cached hashes below 12 (another inode for
    small files; seen at the time inode)."""
    files = _docs(spark, d)
    side = files.where("source < 5").select("path", "size", F.when(F.col("mtime") > 500, F.col("mtime")).otherwise(-1).alias("mtime"), "md5")
    known = files.where("source < 12").select("path", "size", "mtime", F.when(F.col("size") > 1000, F.col("inode")).otherwise(-1).alias("inode"), F.concat(F.lit("c"), "md5").alias("md5"), F.col("inode").alias("seen"))
    return hashing.with_known_hashes(files, side, known, _NOW, max_age=999_800).select("path", "hash_origin", "md5")


@_query("hash_origins", f"""with {_FILES} select case when source < 5 then 'sidecar' else 'read' end as hash_origin, count(*) as n from files group by 1""")
def hash_origins(spark, d):
    files = _docs(spark, d)
    stand_in = lambda rest: rest.drop("md5", "hash_origin").withColumn("md5", F.lit("x")).withColumn("hash_origin", F.lit("read"))
    return hashing.statistics(hashing.resolve(files, files.where("source < 5"), None, _NOW, reader=stand_in))


@_query("cache_upsert", f"""with {_FILES} select path, size, mtime, inode, md5, case when source < 12 then 2 else 1 end::bigint as seen from files""")
def cache_upsert(spark, d):
    files = _docs(spark, d)
    old = files.select("path", "size", F.when(F.col("source") < 12, -1).otherwise(F.col("mtime")).cast("long").alias("mtime"), "inode", "md5", F.lit(1).cast("long").alias("seen"))
    return hashing.upserted(old, files.where("source < 12").withColumn("hash_origin", F.lit("read")), 2)


@_query("chunk_hashes", "select doc_id, k::integer as chunk, md5(substr(t, 1000 * k + 1, 1000)) as md5 from (select doc_id, t, unnest(range(0, greatest(1, (length(t) + 999) // 1000))) as k from (select doc_id, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '?', 'g') as t from documents))")
def chunk_hashes(spark, d):
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "?")
    return catalog.table(spark, d, "documents").select("doc_id", F.posexplode(hashing.chunk_hashes(text.cast("binary"), 1000)).alias("chunk", "md5"))


# --- trees -------------------------------------------------------------------------------


@_query("dir_stats", f"with {_TREE} select dir, count(*) as n, sum(size)::bigint as bytes from ind group by dir")
def dir_stats(spark, d):
    return trees.fingerprints(trees.in_directories(_bk(spark, d))).select("dir", "n", "bytes")


_PAIR = ["dir_a", "dir_b", "file_count", "total_size"]


@_query("tree_pairs_fast", f"with {_tree_pairs('mtime')} select dir_a, dir_b, file_count, total_size from pairs")
def tree_pairs_fast(spark, d):
    return trees.identical_trees(_held(spark, d), "fast", prune=False).select(*_PAIR)


@_query("tree_pairs_content", f"with {_tree_pairs('md5')} select dir_a, dir_b, file_count, total_size from pairs")
def tree_pairs_content(spark, d):
    return trees.identical_trees(_held(spark, d), "content", prune=False).select(*_PAIR)


@_query("tree_pairs_undominated", f"with {_tree_pairs('md5')}{_UNDOMINATED} select dir_a, dir_b, file_count, total_size from best")
def tree_pairs_undominated(spark, d):
    return trees.identical_trees(_held(spark, d), "content").select(*_PAIR)


@_query("tree_guard", f"""with {_tree_pairs('mtime')} select dir_a, dir_b, file_count, total_size from pairs where dir_a not in (select dir from ind where size < 300) and dir_b not in (select dir from ind where size < 300)""")
def tree_guard(spark, d):
    """Directories with a file that a filter would hide are no tree duplicates."""
    files = _held(spark, d)
    gaps = trees.incomplete_directories(files.withColumn("accepted", F.col("size") >= 300))
    return trees.identical_trees(files, "fast", prune=False, incomplete=gaps).select(*_PAIR)


_EXACT = f"""{_TREE}, {_members('bk')}, stats as (select dir, count(*) as n, sum(size)::bigint as bytes from ind group by dir),
held as (select i.dir, m.gid, count(*) as c from ind i join mem m on i.path = m.path group by i.dir, m.gid),
sets as (select dir, sum(c) as n, md5(string_agg(gid{{}}, chr(10) order by gid)) as fp from held group by dir),
prints as (select s.dir, s.n, s.bytes, t.fp from stats s join sets t on s.dir = t.dir and s.n = t.n)
select a.dir as dir_a, b.dir as dir_b, a.n as file_count, a.bytes as total_size from prints a join prints b on a.fp = b.fp and a.n = b.n and a.dir < b.dir
where not starts_with(b.dir, a.dir || '/') and not starts_with(a.dir, b.dir || '/'){{}}"""


@_query("tree_pairs_coverage", "with " + _EXACT.format("", ""))
def tree_pairs_coverage(spark, d):
    files = _held(spark, d)
    return trees.covering_trees(files, groups.members(files), prune=False).select(*_PAIR)


@_query("tree_pairs_coverage_strict", "with " + _EXACT.format(" || chr(9) || c", " and a.bytes = b.bytes"))
def tree_pairs_coverage_strict(spark, d):
    files = _held(spark, d)
    return trees.covering_trees(files, groups.members(files), prune=False, strict=True).select(*_PAIR)


_COVER = f"""{_TREE}, {_members('bk')}, stats as (select dir, count(*) as n, sum(size)::bigint as bytes from ind group by dir),
home as (select distinct gid, root, regexp_replace(path, '/[^/]*$', '') as dir from mem),
capped as (select * from (select *, row_number() over (partition by gid order by dir) as k from home) where k <= 50),
near as (select distinct a.dir as da, a.root as ra, b.dir as db, b.root as rb from capped a join capped b on a.gid = b.gid and a.dir < b.dir),
steps as (select *, unnest(range(0, 12)) as k, string_split(da, '/') as pa, string_split(db, '/') as pb, len(string_split(ra, '/')) as la, len(string_split(rb, '/')) as lb from near),
lifted as (select array_to_string(pa[1:len(pa) - k], '/') as x, array_to_string(pb[1:len(pb) - k], '/') as y from steps where len(pa) - k >= la and len(pb) - k >= lb),
cand as (select distinct least(x, y) as dir_a, greatest(x, y) as dir_b from lifted where x <> y and not starts_with(x, y || '/') and not starts_with(y, x || '/')),
sized as (select c.*, a.n as file_count, a.bytes as total_size, b.bytes as other from cand c join stats a on c.dir_a = a.dir join stats b on c.dir_b = b.dir and a.n = b.n),
held as (select i.dir, m.gid, count(*) as c from ind i join mem m on i.path = m.path group by i.dir, m.gid),
pairwise as (select s.dir_a, s.dir_b, a.gid, a.c as ca, b.c as cb from sized s join held a on s.dir_a = a.dir join held b on s.dir_b = b.dir and a.gid = b.gid),
total as (select dir_a, dir_b, sum(ca) as sa, sum(cb) as sb from pairwise {{}} group by dir_a, dir_b),
found as (select s.dir_a, s.dir_b, s.file_count, s.total_size from sized s join total t on s.dir_a = t.dir_a and s.dir_b = t.dir_b where t.sa = s.file_count and t.sb = s.file_count{{}})
select * from found"""


@_query("tree_pairs_lifted", "with " + _COVER.format("", ""))
def tree_pairs_lifted(spark, d):
    """The bounded form: 50 parents, 12 levels."""
    files = _held(spark, d)
    return trees.lifted_trees(files, groups.members(files), prune=False).select(*_PAIR)


@_query("tree_pairs_lifted_strict", "with " + _COVER.format("where ca = cb", " and s.total_size = s.other"))
def tree_pairs_lifted_strict(spark, d):
    files = _held(spark, d)
    return trees.lifted_trees(files, groups.members(files), prune=False, strict=True).select(*_PAIR)


#: Each order is a directory of its lines as files, so few contents make very large classes.
_ORDERS = """files as (select distinct '/o' || l_orderkey as dir, l_linenumber as entry, l_linenumber * 10 as size from lineitem),
dirs as (select dir, count(*) as n, sum(size)::bigint as bytes, string_agg(entry::varchar, ',' order by entry) as fp from files group by dir),
tops as (select fp, min(dir) as class_id, count(*) as dirs from dirs where n >= 2 group by fp having count(*) > 1)"""


def _orders(spark, d):
    rows = catalog.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    rel = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    return rows.select(F.concat(F.lit("/"), rel).alias("path"), rel.alias("relpath"), F.lit("/").alias("root"), (F.col("l_linenumber") * 10).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), F.col("l_linenumber").cast("string").alias("md5"))


@_query("tree_classes", f"with {_ORDERS} select d.dir, t.class_id, d.n as file_count, d.bytes as total_size, t.dirs from dirs d join tops t on d.fp = t.fp")
def tree_classes(spark, d):
    """Classes of thousands of identical directories, a row for each directory."""
    return trees.identical_classes(_orders(spark, d), "content").select("dir", "class_id", F.col("n").alias("file_count"), F.col("bytes").alias("total_size"), "dirs")


@_query("tree_stars", f"with {_ORDERS} select t.class_id as dir_a, d.dir as dir_b, d.n as file_count, d.bytes as total_size from dirs d join tops t on d.fp = t.fp where t.dirs > 100 and d.dir <> t.class_id"
  " union all select a.dir, b.dir, a.n, a.bytes from dirs a join tops t on a.fp = t.fp join dirs b on a.fp = b.fp and a.dir < b.dir where t.dirs <= 100")
def tree_stars(spark, d):
    """Pairs of the same: every two of a class of up to 100, stars beyond."""
    return trees.pairs_of(trees.identical_classes(_orders(spark, d), "content"), 100).select(*_PAIR)


@_query("tree_pairs_reoriented", f"with {_tree_pairs('md5')}{_UNDOMINATED} select case when {_swap('dir_a', 'dir_b')} then dir_b else dir_a end as keep, case when {_swap('dir_a', 'dir_b')} then dir_a else dir_b end as drop_dir, total_size from best")
def tree_pairs_reoriented(spark, d):
    pairs = trees.identical_trees(_held(spark, d), "content")
    return queue.oriented(pairs, "dir_a", "dir_b").select("keep", F.col("drop").alias("drop_dir"), "total_size")


# --- overlap, queue, plans -------------------------------------------------------------------


_PART = f"{_BK}, part as (select * from bk where source <> ascii(substr(md5, 3, 1)) % 3)"


def _partial(spark, d):
    """Each content in two of the three roots, by a digit of its hash."""
    return cut(_bk(spark, d).where(F.col("source") != F.ascii(F.substring("md5", 3, 1)) % 3))


@_query("overlap_blocks", f"with {_PART}, {_members('part')}{_BLOCKS} select col_a, col_b, block_no::integer as block_no, count(*) as items, sum(size)::bigint as shared_bytes from items group by 1, 2, 3")
def overlap_blocks(spark, d):
    rows = groups.members(_partial(spark, d))
    return overlap.blocks(overlap.items(rows, F.col("root")))


@_query("overlap_remaining", f"with {_PART}, {_members('part')}{_BLOCKS} select distinct gid, size from mem where gid not in (select gid from items)")
def overlap_remaining(spark, d):
    rows = groups.members(_partial(spark, d))
    return overlap.remaining(rows.select("gid", "size").distinct(), overlap.items(rows, F.col("root")))


@_query("overlap_files", f"with {_PART}, {_members('part')}{_BLOCKS} select i.gid, m.path, case when m.root = i.col_a then 'a' else 'b' end as side, i.block_no::integer as block_no from items i join mem m on i.gid = m.gid where m.root in (i.col_a, i.col_b)")
def overlap_files(spark, d):
    rows = groups.members(_partial(spark, d))
    return overlap.block_files(overlap.items(rows, F.col("root")), rows, F.col("root")).select("gid", "path", "side", "block_no")


def _actions(spark, d):
    files = _held(spark, d)
    rows = groups.members(files)
    pairs = trees.identical_trees(files, "content")
    blocks = overlap.blocks(overlap.items(rows, F.col("root")))
    return queue.queue(pairs, blocks, groups.groups(files))


_QUEUE = f"""{_tree_pairs('md5')}{_UNDOMINATED}, {_members('bk')}{_BLOCKS}, acts as (
  select 'tree' as kind, 0 as kind_rank, total_size as waste, case when {_swap('dir_a', 'dir_b')} then dir_b else dir_a end as keep, file_count as items from best
  union all select 'overlap', 1, sum(size)::bigint, case when {_swap('col_a', 'col_b')} then col_b else col_a end, count(*) from items group by col_a, col_b, block_no
  union all select 'group', 2, size * (n - 1), min(path), n from mem group by gid, size, n)"""


@_query("action_queue", f"with {_QUEUE} select kind, waste::bigint as waste, keep, items from acts")
def action_queue(spark, d):
    return _actions(spark, d).select("kind", "waste", "keep", "items")


@_query("queue_totals", f"with {_QUEUE} select kind, count(*) as actions, sum(waste)::bigint as waste from acts group by kind")
def queue_totals(spark, d):
    return queue.totals(_actions(spark, d))


@_query("top_actions", f"with {_QUEUE} select kind, waste::bigint as waste, keep, items from acts order by waste desc, kind_rank, keep limit 10")
def top_actions(spark, d):
    return queue.best_actions(_actions(spark, d), 10).select("kind", "waste", "keep", "items")


@_query("keep_plan", f"with {_BK}, {_members('bk')}{_RANKED} select gid, path, size, case when k = 1 then 'keep' else 'dispose' end as action from ranked")
def keep_plan(spark, d):
    return queue.keep_first(groups.members(_bk(spark, d)))


@_query("glob_plan", f"""with {_BK}, {_members('bk')}{_RANKED}, hits as (select *, regexp_full_match(path, '/bk/.*ly-1/src[0-9]?/.*') as hit, bool_and(regexp_full_match(path, '/bk/.*ly-1/src[0-9]?/.*')) over (partition by gid) as every from ranked)
  select gid, path, size, case when hit and not (every and k = 1) then 'dispose' else 'keep' end as action from hits""")
def glob_plan(spark, d):
    return queue.by_glob(groups.members(_bk(spark, d)), "/bk/*ly-1/src?/*")


SQL["glob_plan"] = SQL["glob_plan"].replace("src[0-9]?/", "src./")


@_query("disposal_plan", f"""with {_tree_pairs('md5')}{_UNDOMINATED}, {_members('bk')}{_RANKED},
dropped as (select distinct case when {_swap('dir_a', 'dir_b')} then dir_a else dir_b end as dir from best),
named as (select path, min(k) as kind from (select path, 0 as k from ind join dropped using (dir) union all select path, 2 from ranked where k > 1) group by path),
whole as (select size || ':' || md5 as gid, count(*) as c from bk group by 1),
gone as (select b.size || ':' || b.md5 as gid, count(*) as c from bk b join named using (path) group by 1),
firsts as (select path from ranked where k = 1 union select b.path from bk b join whole w on b.size || ':' || b.md5 = w.gid where w.c = 1)
select n.path, b.size, case when w.c = g.c and f.path is not null then 'keep' else 'dispose' end as action,
  case when w.c = g.c and f.path is not null then 'survivor' when kind = 0 then 'tree' else 'group' end as reason
from named n join bk b using (path) join whole w on b.size || ':' || b.md5 = w.gid join gone g on w.gid = g.gid left join firsts f on n.path = f.path""")
def disposal_plan(spark, d):
    files = _held(spark, d)
    pairs = queue.oriented(cut(trees.identical_trees(files, "content")), "dir_a", "dir_b")
    gone = queue.keep_first(groups.members(files)).where("action = 'dispose'")
    return queue.disposal_plan(files, {"tree": queue.tree_disposals(files, pairs), "group": gone}).drop("evidence")


# --- partial overlap with something left over, and the plans made of it ------------------


#: A third root holds some of the contents, so some groups lie in three columns and in no block.
_THIRDS = f"{_BK}, part as (select * from bk where source <> ascii(substr(md5, 3, 1)) % 3 or substr(md5, 4, 1) = '7')"


def _thirds(spark, d):
    return cut(_bk(spark, d).where((F.col("source") != F.ascii(F.substring("md5", 3, 1)) % 3) | (F.substring("md5", 4, 1) == "7")))


@_query("overlap_loose", f"with {_THIRDS}, {_members('part')}{_BLOCKS} select distinct gid, size from mem where gid not in (select gid from items)")
def overlap_loose(spark, d):
    """Groups that no block absorbs, as they lie in three columns."""
    rows = groups.members(_thirds(spark, d))
    return overlap.remaining(rows.select("gid", "size").distinct(), overlap.items(rows, F.col("root")))


_GONE_SIDES = f"""{_THIRDS}, {_members('part')}{_BLOCKS},
sides as (select i.gid, m.path, m.size, m.md5, m.source, case when m.root = i.col_a then 'a' else 'b' end as side, case when {_swap('col_a', 'col_b')} then 'a' else 'b' end as drop_side
  from items i join mem m on i.gid = m.gid where m.root in (i.col_a, i.col_b))"""


@_query("overlap_plan", f"with {_GONE_SIDES} select path, size, 'dispose' as action, 'overlap' as reason from sides where side = drop_side")
def overlap_plan(spark, d):
    """Column deletion: the less preferred side of every block goes. Each content stays on the other."""
    files = _thirds(spark, d)
    rows = groups.members(files)
    items = overlap.items(rows, F.col("root"))
    gone = queue.dropped_files(queue.oriented(overlap.block_files(items, rows, F.col("root")), "col_a", "col_b"))
    return queue.disposal_plan(files, {"overlap": gone}).drop("evidence")


@_query("glob_sides", f"""with {_tree_pairs('md5')}{_UNDOMINATED} select dir_a, dir_b, case when regexp_full_match(dir_a, '/bk/daily.*') then dir_a else dir_b end as drop_dir from best
  where regexp_full_match(dir_a, '/bk/daily.*') <> regexp_full_match(dir_b, '/bk/daily.*')""")
def glob_sides(spark, d):
    pairs = trees.identical_trees(_held(spark, d), "content")
    return queue.glob_side(pairs, "dir_a", "dir_b", "/bk/daily*").select("dir_a", "dir_b", F.col("drop").alias("drop_dir"))


_DELETED = "regexp_matches(path, '[13]\\.txt$')"


@_query("live_items", f"""with {_GONE_SIDES} select gid, col_a, col_b from items where gid in (
  select gid from sides where not {_DELETED} group by gid having bool_or(side = 'a') and bool_or(side = 'b'))""")
def live_items(spark, d):
    """Items of blocks that are not moot after some files went."""
    files = _thirds(spark, d)
    rows = groups.members(files)
    items = overlap.items(rows, F.col("root"))
    gone = files.where(F.col("path").rlike("[13]\\.txt$"))
    return queue.live_items(items, overlap.block_files(items, rows, F.col("root")), gone).select("gid", "col_a", "col_b")


@_query("live_groups", f"with {_BK}, {_members('bk')}, rest as (select * from mem where not {_DELETED}) select gid, path from rest where gid in (select gid from rest group by gid having count(*) > 1)")
def live_groups(spark, d):
    files = _held(spark, d)
    return queue.live_groups(groups.members(files), files.where(F.col("path").rlike("[13]\\.txt$"))).select("gid", "path")


@_query("chosen_plan", f"""with {_BK}, {_members('bk')}{_RANKED} select gid, path, size, case when k in (1, 3) and not (k = 1 and n_all <= 2) then 'dispose' else 'keep' end as action from ranked""")
def chosen_plan(spark, d):
    """Places 0 and 2 of every group go; one copy stays."""
    return queue.chosen(groups.members(_held(spark, d)), [0, 2])


@_query("action_items", f"""with {_tree_pairs('md5')}{_UNDOMINATED}, drops as (select distinct case when {_swap('dir_a', 'dir_b')} then dir_b else dir_a end as keep, case when {_swap('dir_a', 'dir_b')} then dir_a else dir_b end as dir from best)
select 'tree' as kind, d.keep, d.dir as drop_dir, i.path, i.size from drops d join ind i on i.dir = d.dir""")
def action_items(spark, d):
    """The files that each tree action disposes of."""
    files = _held(spark, d)
    return queue.tree_items(files, queue.oriented(trees.identical_trees(files, "content"), "dir_a", "dir_b")).select("kind", "keep", F.col("drop").alias("drop_dir"), "path", "size")


# --- reports, media, streams --------------------------------------------------------------


def _nested(spark, d):
    return groups.nested(groups.members(_docs(spark, d)))


_NESTED = f"{_FILES}, {_members('files')}, nest as (select gid, size, count(*) as n, list(path order by path) as files from mem group by gid, size)"


@_query("report_csv_rows", f"with {_NESTED} select size as size_bytes, {_human('size')} as size_human, array_to_string(files, '|') as files from nest")
def report_csv_rows(spark, d):
    return report.group_csv(_nested(spark, d))


@_query("report_simple_rows", f"with {_NESTED} select gid, size, (k - 1)::integer as line_no, coalesce(files[k], '') as line from (select *, unnest(range(1, n + 2)) as k from nest)")
def report_simple_rows(spark, d):
    return report.group_simple(_nested(spark, d))


@_query("report_columns_rows", f"""with {_NESTED} select gid, size, case when n = 2 then files[1] || '  |  ' || files[2] || '  |  ' || {_human('size')}
  else '# ' || n || ' copies, ' || {_human('size')} || ' each' || chr(10) || '  ' || array_to_string(files, chr(10) || '  ') end as text from nest""")
def report_columns_rows(spark, d):
    return report.group_columns(_nested(spark, d))


@_query("report_json_rows", f"with {_NESTED} select gid, '{{\"size\":' || size || ',\"files\":[\"' || array_to_string(files, '\",\"') || '\"]}}' as json from nest")
def report_json_rows(spark, d):
    return report.group_json(_nested(spark, d))


@_query("tree_report_csv", f"with {_tree_pairs('md5')}{_UNDOMINATED} select 'tree' as type, total_size as size_bytes, {_human('total_size')} as size_human, file_count, dir_a, dir_b from best")
def tree_report_csv(spark, d):
    return report.tree_csv(trees.identical_trees(_held(spark, d), "content"))


@_query("tree_report_json", f"""with {_tree_pairs('md5')}{_UNDOMINATED} select dir_a, dir_b, '{{{{"total_size":' || total_size || ',"file_count":' || file_count || ',"dirs":["' || dir_a || '","' || dir_b || '"]}}}}' as json from best""".replace("{{", "{").replace("}}", "}"))
def tree_report_json(spark, d):
    return report.tree_json(trees.identical_trees(_held(spark, d), "content"))


@_query("tree_report_columns", f"with {_tree_pairs('md5')}{_UNDOMINATED} select dir_a, dir_b, total_size, {_human('total_size')} || '  (' || file_count || ' files)' || chr(10) || '  ' || dir_a || chr(10) || '  ' || dir_b as text from best")
def tree_report_columns(spark, d):
    return report.tree_columns(trees.identical_trees(_held(spark, d), "content"))


@_query("largest_groups", f"with {_FILES} select size, md5, count(*) as n from files group by size, md5 having count(*) > 1 order by size desc, md5 limit 20")
def largest_groups(spark, d):
    return groups.largest_first(groups.groups(_docs(spark, d))).select("size", "md5", "n").limit(20)


@_query("tree_seeded", f"""with {_tree_pairs('md5')}, seeds as (select * from pairs where file_count >= 5), other as (select * from pairs where file_count < 5)
select dir_a, dir_b, file_count, total_size from other p where not exists (select 1 from pairs q where (q.dir_a <> p.dir_a or q.dir_b <> p.dir_b) and (
  (starts_with(p.dir_a || '/', q.dir_a || '/') and starts_with(p.dir_b || '/', q.dir_b || '/')) or
  (starts_with(p.dir_a || '/', q.dir_b || '/') and starts_with(p.dir_b || '/', q.dir_a || '/'))))""")
def tree_seeded(spark, d):
    """A later pass: pairs known before are not given again, and drop what is below them."""
    files = _held(spark, d)
    seeds = cut(trees.identical_trees(files, "content", prune=False).where("file_count >= 5"))
    return trees.identical_trees(files, "content", seeds=seeds).select(*_PAIR)


@_query("media_facts", """select doc_id, 1920 + doc_id % 7 as width, 1080 as height, case when doc_id % 2 = 0 then 12.5 else doc_id + 0.25 end::double as duration_sec,
  case when doc_id % 3 = 0 then 'A' || doc_id else 'C' end as capture_time, 'h264' as codec, case when doc_id % 5 = 0 then null else '25/1' end as frame_rate, 'mov' as format_name from documents""")
def media_facts(spark, d):
    """Probe JSON made from the ids: durations and times in the container or in a stream."""
    i = F.col("doc_id")
    tags = F.when(i % 3 == 0, F.concat(F.lit('{"creation_time": "", "DateTimeOriginal": "A'), i, F.lit('"}'))).otherwise(F.lit("{}"))
    rate = F.when(i % 5 == 0, F.lit("0/0")).otherwise(F.lit("25/1"))
    probe = F.concat(
        F.lit('{"streams": [{"codec_type": "audio", "codec_name": "aac", "duration": "bad"}, {"codec_type": "video", "width": 0}, {"codec_type": "video", "codec_name": "h264", "height": 1080, "width": '),
        (1920 + i % 7).cast("string"), F.lit(', "avg_frame_rate": "'), rate, F.lit('", "tags": '), tags, F.lit(', "duration": "'), i + 0.25, F.lit('"}], "format": {"format_name": "mov", "tags": {"creation_time": "C"}, "duration": "'),
        F.when(i % 2 == 0, F.lit("12.5")).otherwise(F.lit("0")), F.lit('"}}'),
    )
    m = media.media_facts(probe)
    return catalog.table(spark, d, "documents").select("doc_id", m.alias("m")).select("doc_id", "m.width", "m.height", "m.duration_sec", "m.capture_time", "m.codec", "m.frame_rate", "m.format_name")


SQL["media_facts"] = SQL["media_facts"].replace("1920 + doc_id % 7 as width", "(1920 + doc_id % 7)::integer as width")


@_query("event_repeats", "select time_bucket(interval '1 hour', ts) as window_start, user_id, event_type, count(*) - 1 as repeats from events group by 1, 2, 3")
def event_repeats(spark, d):
    return dedup.repeats_by_window(catalog.table(spark, d, "events"), ["user_id", "event_type"])


@_query("first_events", "select user_id, event_type, min(ts) as first_ts from events group by user_id, event_type")
def first_events(spark, d):
    return dedup.first_events(catalog.table(spark, d, "events"), ["user_id", "event_type"]).select("user_id", "event_type", F.col("ts").alias("first_ts"))
