"""Translation of user-written patterns to the Java engine, and their safety check.

User rules are written for an engine where ``\\b`` and ``\\w`` are ASCII, ``\\s`` holds the Unicode
spaces, ``$`` means the very end, and ``[`` or ``&&`` inside a class are literal. Constructs that
would silently mean something else in Java are rewritten or rejected.
"""

from __future__ import annotations

import re

from veilspark.functions.kinds import MAX_PATTERN_CHARS
from veilspark.functions.patterns import SPACE_CHARS

# Fixed value: a quantified group or class that itself holds a quantifier.
NESTED_QUANTIFIER = r"(\([^)]*[+*{?][^)]*\)|\[[^\]]*[+*{?][^\]]*\])[+*{]"

BORDER = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
NOT_BORDER = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
FLAGS = frozenset("gimsduv")


class RuleError(ValueError):
    """A custom rule that must not be used."""


def check_safe(name: str, pattern: str) -> None:
    """Reject over-long patterns and nested quantifiers, before any job is started."""
    if len(pattern) > MAX_PATTERN_CHARS:
        raise RuleError(f"rule {name!r}: patterns may have at most {MAX_PATTERN_CHARS} characters")
    if re.search(NESTED_QUANTIFIER, pattern):
        raise RuleError(f"rule {name!r}: a quantifier inside a quantified group or class can take for ever")


def java_flags(name: str, flags: str | None) -> str:
    """The inline flag prefix for ``flags``; ``g`` is always on and needs none."""
    given = flags or ""
    if "y" in given:
        raise RuleError(f"rule {name!r}: flag 'y' cannot be used on a column")
    if len(set(given)) != len(given) or not set(given) <= FLAGS or {"u", "v"} <= set(given):
        raise RuleError(f'rule {name!r}: invalid regex: bad flags {given!r}')
    inline = "".join(f for f in "ims" if f in given)
    return f"(?{inline})" if inline else ""


def to_java(name: str, pattern: str, flags: str | None = "") -> str:
    """The Java form of a user pattern, with its flags in front."""
    prefix = java_flags(name, flags)
    multiline = "m" in (flags or "")
    out: list[str] = []
    i, in_class = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise RuleError(f'rule {name!r}: invalid regex: \\ at end of pattern')
            out.append(_escape(name, pattern[i + 1], in_class, bool({"u", "v"} & set(flags or ""))))
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
                out.append(c)
            elif c == "[" or pattern.startswith("&&", i):
                out.append("\\" + c)
            else:
                out.append(c)
        elif c == "[":
            in_class = True
            if pattern.startswith("[^]", i):
                out.append(r"[\s\S")
                i += 2
                continue
            if pattern.startswith("[]", i):
                out.append(r"[^\s\S")
                i += 1
                continue
            out.append(c)
            if pattern.startswith("[^", i):
                out.append("^")
                i += 1
        elif c == "{" and not re.match(r"\{\d+(,\d*)?\}", pattern[i:]) and not (
            re.search(r"\\[pP]$", pattern[:i]) and {"u", "v"} & set(flags or "")
        ):
            out.append(r"\{")
        elif c == "$" and not multiline:
            out.append(r"\z")
        elif c == "+" and out and i > 0 and _quantified(pattern, i):
            raise RuleError(f'rule {name!r}: invalid regex: nothing to repeat')
        elif pattern.startswith(("(?i", "(?m", "(?s", "(?-"), i) and ":" not in pattern[i : i + 8].split(")")[0]:
            raise RuleError(f'rule {name!r}: invalid regex: invalid group')
        elif pattern.startswith("(?>", i):
            raise RuleError(f'rule {name!r}: invalid regex: invalid group')
        else:
            out.append(c)
        i += 1
    if in_class:
        raise RuleError(f'rule {name!r}: invalid regex: unterminated character class')
    body = "".join(out)
    if "i" in (flags or "") and not pattern.isascii():
        prefix = prefix.replace("(?", "(?u")
    if multiline:
        prefix = prefix.replace("(?", "(?d") if "s" not in (flags or "") else prefix
    return prefix + body


def _quantified(pattern: str, i: int) -> bool:
    """Whether the ``+`` at ``i`` follows a complete quantifier, which Java reads as possessive."""
    before = pattern[:i]
    if re.search(r"\\.$", before):
        return False
    return before[-1] in "*+?" or re.search(r"\{\d+(,\d*)?\}$", before) is not None


def _escape(name: str, c: str, in_class: bool, unicode: bool) -> str:
    if c in "pP" and not unicode:
        return c
    if c == "s":
        return SPACE_CHARS if in_class else f"[{SPACE_CHARS}]"
    if c == "S":
        # Inside a class this is a nested class, that is a union.
        return f"[^{SPACE_CHARS}]"
    if c == "b":
        return "\\x08" if in_class else BORDER
    if c == "B" and not in_class:
        return NOT_BORDER
    if c == "/" or c == "-":
        return "\\" + c
    if c.isalpha() and c not in "dDwWnrtfvxucknpP0":
        # An unknown letter escape is the letter itself; Java would refuse or reinterpret it.
        return c
    if c == "v":
        return "\\x0B"
    return "\\" + c


def quote_terms(terms: list[str]) -> str:
    """Whole-word alternation of literal terms."""
    return BORDER + "(?:" + "|".join(re.sub(r"([.*+?^${}()|\[\]\\&#-])", r"\\\1", t) for t in terms) + ")" + BORDER
