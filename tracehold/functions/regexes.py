"""Regular expressions: shared constants, dialect fixes and literal guards."""

from __future__ import annotations

# Patterns whose matches decide results.
DOTTED_QUAD = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
DOMAIN = r"([a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}"
URL = r"^(https?|ftp)://[^\s/$.?#].[^\s]*$"

# The twelve POSIX bracket classes and what Java calls them.
POSIX_CLASSES = {
    "[:alnum:]": "a-zA-Z0-9",
    "[:alpha:]": "a-zA-Z",
    "[:blank:]": r" \t",
    "[:cntrl:]": r"\x00-\x1f\x7f",
    "[:digit:]": "0-9",
    "[:graph:]": "!-~",
    "[:lower:]": "a-z",
    "[:print:]": " -~",
    "[:punct:]": r"!-/:-@\[-`{-~",
    "[:space:]": r"\s",
    "[:upper:]": "A-Z",
    "[:xdigit:]": "0-9A-Fa-f",
}

#: Characters of a run that is worth a test of its own.
SHORTEST_GUARD = 1


def to_java(pattern: str) -> str:
    """Rewrite POSIX bracket classes, which Java would read as plain characters."""
    for posix, java in POSIX_CLASSES.items():
        pattern = pattern.replace(posix, java)
    return pattern


class _Unknown(Exception):
    """The pattern holds something the guard does not read."""


def literal_guard(pattern: str) -> list[str] | None:
    """Substrings of which every match contains at least one, or None if unknown.

    A cheap ``contains`` test on them may only skip lines the pattern cannot
    match.  The pattern is read as alternatives of items; anything not fully
    understood (flags, quoting, odd escapes or classes) gives None.
    """
    try:
        branches, at = _alternatives(pattern, 0)
        if at != len(pattern):
            return None
        return _guard(branches)
    except _Unknown:
        return None


def _guard(branches: list[list]) -> list[str] | None:
    """One string for each way through the alternatives, where each has one."""
    found: list[str] = []
    for items in branches:
        best = _best(items)
        if best is None:
            return None
        found += best
    return list(dict.fromkeys(found))


def _best(items: list) -> list[str] | None:
    """Of the runs and groups that every match of a branch contains, those with the longest strings.

    Items are characters, None for anything that breaks a run, and lists of
    alternatives for groups that must occur.  A run in front of a group goes on
    in each of its alternatives that is plain text.
    """
    choices: list[list[str]] = []
    runs = [""]
    for item in [*items, None]:
        if isinstance(item, str):
            runs = [r + item for r in runs]
            continue
        if isinstance(item, list):
            inner = _guard(item)
            if inner:
                choices.append(inner)
            if all(isinstance(i, str) for branch in item for i in branch) and len(runs) * len(item) <= 64:
                runs = [r + "".join(branch) for r in runs for branch in item]
                continue
        choices.append(runs)
        runs = [""]
    best = max(choices, key=lambda c: (min(map(len, c)), -len(c)))
    return best if min(map(len, best)) >= SHORTEST_GUARD else None


def _alternatives(pattern: str, at: int) -> tuple[list[list], int]:
    """Branches up to the end or a closing parenthesis, and where that is."""
    branches: list[list] = [[]]
    while at < len(pattern) and pattern[at] != ")":
        if pattern[at] == "|":
            branches.append([])
            at += 1
            continue
        item, at = _item(pattern, at)
        least, most, at = _quantifier(pattern, at)
        if least == 0:
            item = None
        branches[-1].append(item)
        if most != 1 and item is not None:
            branches[-1].append(None)  # what follows does not stand next to the first occurrence
    return branches, at


def _item(pattern: str, at: int) -> tuple[object, int]:
    c = pattern[at]
    if c == "(":
        if pattern.startswith("(?", at):
            raise _Unknown
        branches, end = _alternatives(pattern, at + 1)
        if end >= len(pattern):
            raise _Unknown
        return branches, end + 1
    if c == "[":
        return None, _bracket_end(pattern, at)
    if c == "\\":
        return _escape(pattern, at)
    if c in ".^$":
        return None, at + 1
    if c in "*+?{":
        raise _Unknown
    return c, at + 1


def _escape(pattern: str, at: int) -> tuple[str | None, int]:
    if at + 1 >= len(pattern):
        raise _Unknown
    c = pattern[at + 1]
    if not c.isalnum():
        return c, at + 2
    if c in "dDsSwWbBAzZhHvVtnrfae":
        return None, at + 2
    width = {"x": 2, "u": 4}.get(c)
    digits = pattern[at + 2 : at + 2 + width] if width else ""
    if width and len(digits) == width and all(d in "0123456789abcdefABCDEF" for d in digits):
        code = int(digits, 16)
        # A lone half of a surrogate pair is no character of a text.
        return (None if 0xD800 <= code <= 0xDFFF else chr(code)), at + 2 + width
    raise _Unknown


def _bracket_end(pattern: str, at: int) -> int:
    """The position behind a plain bracket expression; nested, empty or intersected ones are not read."""
    at += 1
    if pattern.startswith("^", at):
        at += 1
    if pattern.startswith("]", at):
        raise _Unknown
    while at < len(pattern) and pattern[at] != "]":
        if pattern[at] == "[" or pattern.startswith("&&", at):
            raise _Unknown
        if pattern[at] == "\\":
            if pattern[at + 1 : at + 2] in ("Q", "E", "N", "c", "p", "P", ""):
                raise _Unknown
            at += 1
        at += 1
    if at >= len(pattern):
        raise _Unknown
    return at + 1


def _quantifier(pattern: str, at: int) -> tuple[int, int | None, int]:
    """Least and most repetitions, and the position behind."""
    c = pattern[at : at + 1]
    if c == "{":
        end = pattern.find("}", at)
        low, comma, high = pattern[at + 1 : end].partition(",")
        if end < 0 or not low.isdigit() or (high and not high.isdigit()):
            raise _Unknown
        least, most = int(low), int(high) if high else (None if comma else int(low))
        at = end + 1
    elif c and c in "*+?":
        least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        at += 1
    else:
        return 1, 1, at
    if pattern[at : at + 1] in ("?", "+"):
        at += 1
    return least, most, at
