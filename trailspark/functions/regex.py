"""Regular expressions in RE2 syntax, rewritten for Java."""

from __future__ import annotations

import re

MAX_PATTERN = 512

_POSIX = {"alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\s", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}"}


class RegexError(ValueError):
    pass


def quote(text: str) -> str:
    """A literal as a pattern."""
    return re.sub(r"([\\.+*?()|\[\]{}^$&#~-])", r"\\\1", text)


def to_java(pattern: str, limit: int = MAX_PATTERN) -> str:
    """The same pattern for Java; what RE2 does not know is rejected."""
    if len(pattern.encode()) > limit:
        raise RegexError(f"regular expression exceeds {limit} bytes")
    out: list[str] = []
    i, depth, multiline = 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 >= len(pattern):
                raise RegexError("trailing backslash")
            e = pattern[i + 1]
            if e == "Q":
                end = pattern.find("\\E", i + 2)
                end = len(pattern) if end < 0 else end
                out.append(quote(pattern[i + 2 : end]))
                i = end + 2
                continue
            if e.isdigit() and e != "0":
                raise RegexError("back-references are not supported")
            if e in "kGRXZCh" or e in "KNVvH" and not depth and e != "v":
                raise RegexError(f"escape \\{e} is not supported")
            if e in "pP" and pattern[i + 2 : i + 3] not in ("{", ""):
                out.append(f"\\{e}{{{pattern[i + 2]}}}")
                i += 3
                continue
            if e == "x" and pattern[i + 2 : i + 3] == "{":
                out.append("\\x")
                i += 2
                continue
            out.append(c + e)
            i += 2
            continue
        if depth:
            if c == "[":
                m = re.match(r"\[:(\^?)(\w+):\]", pattern[i:])
                if m:
                    if m[2] not in _POSIX:
                        raise RegexError(f"unknown class {m[0]}")
                    name = _POSIX[m[2]]
                    out.append(name.upper() if m[1] and len(name) == 2 else name.replace(r"\p", r"\P") if m[1] else name)
                    i += len(m[0])
                    continue
                out.append(r"\[")
            elif c == "]":
                depth = 0
                out.append(c)
            elif c == "&":
                out.append(r"\&")
            else:
                out.append(c)
            i += 1
            continue
        if c == "[":
            depth = 1
            out.append(c)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            if pattern[i : i + 1] == "]":
                out.append(r"\]")
                i += 1
            continue
        if c == "(" and pattern[i + 1 : i + 2] == "?":
            if m := re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[i:]):
                # Java's group names hold no underscore, and none is read by name here
                out.append("(")
                i += len(m[0])
                continue
            m = re.match(r"\(\?([imsU]*(?:-[imsU]+)?)([:)])", pattern[i:])
            if not m:
                raise RegexError("look-around is not supported")
            on, _, off = m[1].partition("-")
            if "U" in on + off:
                raise RegexError("flag U is not supported")
            multiline |= "m" in on
            out.append("(?" + on.replace("i", "iu") + ("-" + off.replace("i", "iu") if off else "") + m[2])
            i += len(m[0])
            continue
        if c == "$":
            out.append("$" if multiline else r"\z")
        elif c in "*+?}" and pattern[i + 1 : i + 2] == "+":
            raise RegexError("possessive repetition is not supported")
        else:
            out.append(c)
        i += 1
    if depth:
        raise RegexError("missing closing ]")
    java = "".join(out)
    try:
        re.compile(re.sub(r"\\p\{\w+\}|\\P\{\w+\}", r"\\w", java).replace(r"\z", r"\Z").replace("iu", "i") if "(?" not in java else ".")
    except re.error as e:
        raise RegexError(str(e)) from e
    return java


def n_groups(pattern: str) -> int:
    """Capturing groups of a pattern."""
    n, i, inside = 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
            i += 1 + (pattern[i + 1 : i + 2] == "^")
            i += pattern[i : i + 1] == "]"
            continue
        if c == "]":
            inside = False
        elif c == "(" and not inside and (pattern[i + 1 : i + 2] != "?" or re.match(r"\(\?P?<[A-Za-z_]", pattern[i:])):
            n += 1
        i += 1
    return n


def term(text: str, left: bool = True, right: bool = True, sensitive: bool = False) -> str:
    """Java pattern of a literal term; boundaries are anything but ASCII letters and digits. The literal stands first, as it fails fastest."""
    return ("" if sensitive else "(?iu)") + quote(text) + (rf"(?<![A-Za-z0-9]{quote(text)})" if left else "") + (r"(?![A-Za-z0-9])" if right else "")
