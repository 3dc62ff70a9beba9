"""Two pattern languages as regular expressions that Java and Python both read.

Path globs (rules): `*` and `?` stay within a path component, `[...]` is a set, `\\`
quotes, `**` spans components. Removal globs: `*` is any run of characters of one line, `?`
any one character, nothing else is special.
"""

from __future__ import annotations

import re

NEVER = None
_ONE_LINE = r"[^\n]"


class _Bad(ValueError):
    pass


def _set(p: str, i: int) -> tuple[str, int]:
    """The set that begins after `[` at i; the place after `]`."""
    out, n = "", 0
    negated = p[i : i + 1] == "^"
    i += negated

    def char(i: int) -> tuple[str, int]:
        if i >= len(p) or p[i] in "-]":
            raise _Bad
        if p[i] == "\\":
            i += 1
        if i + 1 >= len(p):  # a character and something behind it must follow
            raise _Bad
        return p[i], i + 1

    while not (n and p[i : i + 1] == "]"):
        low, i = char(i)
        high = low
        if p[i : i + 1] == "-":
            high, i = char(i + 1)
        if low <= high:
            quote = lambda c: f"\\x{{{ord(c):x}}}"
            out += quote(low) + (f"-{quote(high)}" if high != low else "")
        n += 1
    if not out:  # only empty ranges
        return (r"(?s:.)" if negated else r"(?!)"), i + 1
    return f"[{'^' * negated}{out}]", i + 1


def component_regex(pattern: str) -> str:
    """A pattern without `**`; raises ValueError if it is malformed."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            part, i = _set(pattern, i)
            out += part
        else:
            if c == "\\":
                if i >= len(pattern):
                    raise _Bad
                c, i = pattern[i], i + 1
            out += re.escape(c)
    return out


def _spanning(pattern: str) -> str:
    if "**" not in pattern:
        return component_regex(pattern)
    head, _, tail = pattern.partition("**")
    head, tail = head.removesuffix("/"), tail.removeprefix("/")
    rest = _spanning(tail) if tail else None
    if not head:
        return "(?s:.*)" if rest is None else f"(?:[^/]*/)*(?:{rest})"
    lead = "/".join(component_regex(x) for x in head.split("/"))
    if rest is None:
        return f"{lead}(?:/(?s:.*))?"
    # what follows a head begins at once with the tail; an exhausted path is empty
    end = "|" if python_match(rest, "") else ""
    return f"{lead}(?:/(?:{rest}){end})"


def path_regex(pattern: str) -> str | None:
    """An anchored expression for a path glob; None if it is malformed (never matches)."""
    try:
        return rf"\A(?:{_spanning(pattern)})\z"
    except _Bad:
        return NEVER


def removal_regex(glob: str) -> str:
    """An anchored expression for a removal glob over whole paths."""
    body = "".join(f"{_ONE_LINE}*" if c == "*" else _ONE_LINE if c == "?" else re.escape(c) for c in glob)
    return rf"\A{body}\z"


def python_match(java: str, text: str) -> bool:
    """Whether the expression, as written for Java, matches all of text."""
    body = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), java)
    return re.fullmatch(body.removeprefix(r"\A").removesuffix(r"\z"), text) is not None
