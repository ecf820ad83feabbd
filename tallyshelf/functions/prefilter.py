"""Cheap tests ahead of long pattern lists, and values evaluated once.

Trying dozens of alternatives at every place of a text is the costliest expression in a catalogue
job. Most texts contain none of the words the patterns need, and looking for plain words is far
cheaper, so the patterns only run where one of their words occurs. The result is the same.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def needed_text(pattern: str) -> str | None:
    """Longest plain text that every match of the pattern contains, None if that is unclear."""
    plain = re.sub(r"\\[.]", ".", pattern)
    if re.search(r"\\[^bsdwp]|\{", plain) or "|" in re.sub(r"\([^()]*\)", "", plain):
        return None
    while re.search(r"\([^()]*\)", plain):
        plain = re.sub(r"\([^()]*\)[?*+]?", "\0", plain)
    plain = re.sub(r"\\p\{[^}]*\}[?*+]?|\\[bsdw][?*+]?|\[[^\]]*\][?*+]?|[\^$]", "\0", plain)
    plain = re.sub(r".[?*]", "\0", plain)
    runs = [run for run in re.split(r"[\0+.]", plain) if len(run) > 1 or (run and ord(run) > 127)]
    return max(runs, key=len, default=None)


def could_match(low: Column, patterns: Sequence[str]) -> Column | None:
    """Whether the lower-case text holds the needed text of some pattern; None if unclear for any."""
    words = [needed_text(p) for p in patterns]
    if any(w is None for w in words):
        return None
    # A word that contains another needed word adds nothing.
    kept = [w for w in dict.fromkeys(words) if not any(o != w and o in w for o in words)]
    return any_true([low.contains(w) for w in kept])


def any_true(tests: Sequence[Column]) -> Column:
    """The tests joined by or, as a tree of little depth."""
    tests = list(tests) or [F.lit(False)]
    while len(tests) > 1:
        tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + tests[len(tests) // 2 * 2:]
    return tests[0]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body uses it.

    Catalyst copies projected expressions into filters and conditions; the variable of a lambda
    cannot be taken apart that way.
    """
    return F.get(F.transform(F.array(value), body), 0)


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, split at its outermost bars."""
    out, depth, start, i = [], 0, 0, 0
    in_class = False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


#: Characters that are no plain text at the start of an alternative.
_SPECIAL = "\\[](){}.|?*+^$"


def opening(pattern: str, size: int = 2) -> str:
    """Plain text of at most ``size`` characters that every match of the alternative begins with, edges apart."""
    rest = re.sub(r"^(?:\^|\\b)+", "", pattern)
    out = ""
    for i, c in enumerate(rest[:size]):
        after = rest[i + 1:i + 2]
        if c in _SPECIAL or after and after in "?*{":
            break
        out += c
        if after == "+":
            break
    return out


def _literal(text: str) -> str:
    return "".join(rf"\x{{{ord(c):X}}}" for c in text)


def _tree(branches: dict[str, str], before: str = "") -> str:
    """The expressions keyed by the character after ``before`` that they begin with, found by halving the characters."""
    keys = sorted(branches)
    if len(keys) <= 3:
        return "|".join(f"(?={_literal(before + k)})(?:{branches[k]})" for k in keys)
    half = len(keys) // 2
    return "|".join(f"(?={_literal(before)}[{_literal(''.join(part))}])(?:{_tree({k: branches[k] for k in part}, before)})"
                    for part in (keys[:half], keys[half:]))


def indexed(patterns: Sequence[str], edit: Callable[[str], str] = str) -> str:
    """One expression for all alternatives of the patterns, by an index on what they begin with.

    A place of a text is tried only against alternatives that begin with its character, and with its next
    one where they have two plain characters; an alternative without a plain beginning is tried everywhere.
    ``edit`` rewrites each alternative. Which one matches may differ from trying them in order, whether any
    does may not.
    """
    groups: dict[str, dict[str, list[str]]] = {}
    for a in dict.fromkeys(a for p in patterns for a in alternatives(p)):
        start = opening(a)
        groups.setdefault(start[:1], {}).setdefault(start[1:], []).append(f"(?:{edit(a)})")
    anywhere = [a for some in groups.pop("", {}).values() for a in some]
    branches = {}
    for first, seconds in groups.items():
        single = seconds.pop("", [])
        branches[first] = "|".join([*single, *([_tree({k: "|".join(v) for k, v in seconds.items()}, first)] if seconds else [])])
    # Apart, because a class of characters beyond Latin-1 is a chain of comparisons and the other kind a bit set.
    latin = {k: v for k, v in branches.items() if k <= "\xff"}
    other = {k: v for k, v in branches.items() if k > "\xff"}
    trees = [f"(?=[{_literal(''.join(latin))}])(?:{_tree(latin)})" if latin else "", rf"(?=[^\x00-\xFF])(?:{_tree(other)})" if other else ""]
    return "|".join([*filter(None, trees), *anywhere])


# --- the same patterns by an engine that does not go back --------------------------------------------
# RE2, which comes with Arrow, passes a text once however many alternatives there are. It has neither
# look-around nor Unicode word edges, so it gives a verdict only where it cannot differ from Java.

_PLAIN = "[A-Za-z0-9]"
_GROUP = rf"\((?:\?:)?{_PLAIN}[a-zA-Z0-9-]*{_PLAIN}(?:\|{_PLAIN}[a-zA-Z0-9-]*{_PLAIN})*\)"
_ASCII_EDGE = r"[\x00-/:-@\[-^`{-\x7F]"
_ANY_EDGE = r"[^A-Za-z0-9_]"
_LINE = r"\n\r\x{85}\x{2028}\x{2029}"
#: Letters whose case mapping leads to ASCII; the engines fold some of them differently.
_ODD_CASE = r"[\x{130}\x{131}\x{17F}\x{212A}]"


def _re2(alternative: str, unicode: bool, loose: bool) -> str | None:
    """An alternative of Java's syntax for RE2, None if it has to stay with Java.

    The strict form matches only where Java does, the loose one wherever Java does; they differ next to
    characters beyond ASCII alone. With ``unicode`` an edge is one of Unicode words and is consumed, so it must
    stand outermost, a plain ASCII letter or digit inside.
    """
    body, head, tail = alternative, "", ""
    if unicode:
        edge = _ANY_EDGE if loose else _ASCII_EDGE
        if body.startswith(r"\b"):
            body, head = body[2:], rf"(?:\A|{edge})"
            if not re.match(rf"{_PLAIN}(?![?*{{])|{_GROUP}(?![?*{{])", body):
                return None
        if body.endswith(r"\b"):
            body, tail = body[:-2], rf"(?:{edge}|\z)"
            if not re.search(rf"(?<!\\){_PLAIN}(?:{_PLAIN}\?|{_GROUP}\?)?$|{_GROUP}$", body):
                return None
        if r"\b" in body:
            return None
    if body.endswith("$") and not body.endswith(r"\$"):
        body, tail = body[:-1], (rf"(?:\r\n|[{_LINE}])?\z" if loose else r"\z")
    out, i, in_class = [], 0, False
    beyond = r"\x{80}-\x{10FFFF}" if loose else ""
    sets = {"s": r"\t-\r\x20" + beyond, "d": "0-9" + (beyond if unicode else "")}
    while i < len(body):
        c, pair = body[i], body[i:i + 2]
        if c == "\\":
            kind = pair[1:]
            if kind in sets:
                out.append(sets[kind] if in_class else f"[{sets[kind]}]")
            elif kind == "b" and not in_class:
                out.append(r"\b")
            elif kind == "u":
                out.append(rf"\x{{{body[i + 2:i + 6]}}}")
                i += 4
            elif kind and not kind.isalnum():
                out.append(pair)
            else:
                return None
            i += 2
            continue
        if in_class:
            # A negated class of sets would turn strict and loose about.
            if c in "[&" or (c == "^" and "\\" in body[i:body.find("]", i)]):
                return None
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(" and body[i + 1:i + 2] == "?" and body[i + 1:i + 3] != "?:":
            return None
        elif c == ".":
            c = f"[^{_LINE}]"
        elif c in "$" or (c == "^" and i):
            return None
        elif c in "*+?}" and body[i + 1:i + 2] == "+":
            return None
        elif c == "^":
            c = r"\A"
        out.append(c)
        i += 1
    return f"{head}(?:{''.join(out)}){tail}"


def by_re2(patterns: Sequence[str], unicode: bool, any_case: bool = False) -> tuple[str, str, list[str]]:
    """The strict and the loose expression of the patterns' alternatives, and the alternatives left to Java."""
    strict, loose, left = [], [], []
    for a in dict.fromkeys(a for p in patterns for a in alternatives(p)):
        forms = [_re2(a, unicode, wide) for wide in (False, True)]
        if None in forms:
            left.append(a)
        else:
            strict.append(forms[0])
            loose.append(forms[1])
    if any_case:
        loose.append(_ODD_CASE)
        return "(?i)" + "|".join(strict), "(?i)" + "|".join(loose), left
    return "|".join(strict), "|".join(loose), left


def matches(text: Column, java: str, patterns: Sequence[str], unicode: bool, any_case: bool = False,
            rest: Callable[[list[str]], str] | None = None) -> Column:
    """``text.rlike(java)``, by RE2 where it can tell; ``java`` is the alternatives of ``patterns`` joined.

    ``rest`` makes Java's expression of the alternatives that RE2 cannot take.
    """
    strict, loose, left = by_re2(patterns, unicode, any_case)
    if not strict or (left and rest is None):
        return text.rlike(java)

    # Built here, so that the function travels to executors by value.
    @F.arrow_udf("boolean")
    def verdict(values: pa.Array) -> pa.Array:
        # What only the loose form finds is left open.
        open_ = pc.if_else(pc.match_substring_regex(values, loose), pa.scalar(None, pa.bool_()), False)
        return pc.if_else(pc.match_substring_regex(values, strict), True, open_)

    told = F.coalesce(verdict(text), text.rlike(java))
    return told | text.rlike(rest(left)) if left else told


def matches_any(low: Column, patterns: Sequence[str], flags: str = "", edit: Callable[[str], str] = str) -> Column:
    """Whether lower-case text matches any of the patterns, in one pass over the text.

    ``flags`` is ``(?U)``, or ``edit`` makes the edges those of ASCII words.
    """
    return matches(low, flags + indexed(patterns, edit), patterns, "U" in flags, rest=lambda left: flags + indexed(left, edit))
