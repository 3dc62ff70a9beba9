"""Path expressions: ancestors, containment, columns of the overlap view, display."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent(path: Column) -> Column:
    """The directory of a path; '/' for what stands in the root, '' for a bare name."""
    p = F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise("")
    return F.when(path.startswith("/") & (p == ""), "/").otherwise(p)


def walk_key(path: Column) -> Column:
    """Sorting by this array is the order in which a walk meets paths."""
    return F.split(path, "/")


def proper_ancestors(relpath: Column) -> Column:
    """Of a/b/c: [a, a/b]. Empty for a name without directory."""
    parts = F.split(relpath, "/")
    n = F.size(parts)
    upto = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(n > 1, upto).otherwise(F.array().cast("array<string>"))


def _join(root: Column, rel: Column) -> Column:
    return F.when(root == "/", F.concat(root, rel)).otherwise(F.concat(root, F.lit("/"), rel))


def directories(root: Column, relpath: Column) -> Column:
    """All directories of a file from its root down to its parent, the root included."""
    return F.concat(F.array(root), F.transform(proper_ancestors(relpath), lambda r: _join(root, r)))


def ancestors_or_self(root: Column, directory: Column) -> Column:
    """A directory and those above it, down from the root. Equal to [root] for the root."""
    rel = relative(root, directory)
    return F.when(directory == root, F.array(root)).otherwise(F.concat(directories(root, rel), F.array(directory)))


def relative(root: Column, path: Column) -> Column:
    """The path below root; the whole path if it is not below."""
    lead = F.when(root == "/", F.lit("/")).otherwise(F.concat(root, F.lit("/")))
    return F.when(path.startswith(lead), F.substr(path, F.length(lead) + 1)).otherwise(path)


def is_below(above: Column, path: Column) -> Column:
    """Strict containment; everything but itself is below '/'."""
    lead = F.when(above == "/", F.lit("/")).otherwise(F.concat(above, F.lit("/")))
    return path.startswith(lead) & (F.length(path) > F.length(lead))


def prefix_range(directory: str) -> tuple[str, str]:
    """Half-open range of the paths below a directory: a literal range reaches the scan."""
    lead = directory if directory.endswith("/") else f"{directory}/"
    return lead, lead[:-1] + chr(ord("/") + 1)


def below(path: Column, directory: str) -> Column:
    low, high = prefix_range(directory)
    return (path >= F.lit(low)) & (path < F.lit(high))


def virtual_column(path: Column, root: Column, depth: int) -> Column:
    """The ancestor `depth` levels (1 at least) below root; '' where there is none."""
    depth = max(1, depth)
    rel = relative(root, path)
    parts = F.split(rel, "/")
    found = _join(root, F.array_join(F.slice(parts, 1, depth), "/"))
    return F.when(is_below(root, path) & (F.size(parts) > depth), found).otherwise(F.lit(""))


def innermost(path: Column, roots: list[str]) -> Column:
    """The longest of the roots that contains the path; null if none does."""
    best = F.lit(None).cast("string")
    for r in sorted(set(roots), key=len):
        best = F.when(is_below(F.lit(r), path), F.lit(r)).otherwise(best)
    return best


def truncated_left(text: Column, width: int) -> Column:
    """At most `width` characters, the left ones replaced by an ellipsis."""
    return F.when(F.length(text) > width, F.concat(F.lit("…"), F.right(text, F.lit(width - 1)))).otherwise(text)


def display(first: Column, root: Column, count: Column) -> Column:
    """Path below root, with (+n) for further copies."""
    more = F.when(count > 1, F.concat(F.lit(" (+"), (count - 1).cast("string"), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(relative(root, first), more)


def encoded(path: str) -> str:
    """Percent-encoded segments, `/` kept. Signs that a path segment may hold stay as they are."""
    return "/".join(quote(s, safe="$&+:=@") for s in path.split("/"))


def encoded_column(path: Column) -> Column:
    """The same as a column: form encoding, with what differs put right."""
    fixed = F.regexp_replace(F.url_encode(path), r"\+", "%20")
    for sign, code in (("/", "%2F"), ("$", "%24"), ("&", "%26"), ("+", "%2B"), (":", "%3A"), ("=", "%3D"), ("@", "%40"), ("~", "%7E")):
        fixed = F.replace(fixed, F.lit(code), F.lit(sign))
    return F.replace(fixed, F.lit("*"), F.lit("%2A"))
