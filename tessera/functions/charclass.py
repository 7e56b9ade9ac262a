"""Character classes: sets of code points with an algebra, compiled to one Java class.

Strings are matched by code point.  Indices are counted in code points too.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOP = 0x10FFFF


def _quoted(c: int) -> str:
    return f"\\x{{{c:X}}}"


@dataclass(frozen=True)
class CharClass:
    """``java`` stands inside [...]; it holds items, ranges and nested classes."""

    java: str

    @property
    def regex(self) -> str:
        return f"[{self.java}]"

    def __invert__(self) -> CharClass:
        return CharClass(f"\\x{{0}}-\\x{{10FFFF}}&&[^{self.regex}]")

    def __or__(self, other: CharClass) -> CharClass:
        return CharClass(self.regex + other.regex)

    def __and__(self, other: CharClass) -> CharClass:
        return CharClass(f"{self.regex}&&{other.regex}")

    def __sub__(self, other: CharClass) -> CharClass:
        return self & ~other

    # -- tests and edits of a string column ------------------------------------

    def every_of(self, s: Column) -> Column:
        return s.rlike(f"^{self.regex}*\\z")

    def any_of(self, s: Column) -> Column:
        return s.rlike(self.regex)

    def none_of(self, s: Column) -> Column:
        return ~s.rlike(self.regex)

    def first_index(self, s: Column, start: int = 0) -> Column:
        """0-based place of the first match from start on, or -1."""
        at = F.regexp_instr(F.substring(s, start + 1, 1 << 30), F.lit(self.regex))
        return F.when(at > 0, at - 1 + start).otherwise(F.when(s.isNotNull(), F.lit(-1)))

    def last_index(self, s: Column) -> Column:
        at = F.regexp_instr(F.reverse(s), F.lit(self.regex))
        return F.when(at > 0, F.length(s) - at).otherwise(F.when(s.isNotNull(), F.lit(-1)))

    def count(self, s: Column) -> Column:
        return F.regexp_count(s, F.lit(self.regex))

    def collapse(self, s: Column, to: str) -> Column:
        return F.regexp_replace(s, self.regex + "+", _literal(to))

    def replace(self, s: Column, to: str) -> Column:
        return F.regexp_replace(s, self.regex, _literal(to))

    def remove(self, s: Column) -> Column:
        return self.replace(s, "")

    def retain(self, s: Column) -> Column:
        return (~self).replace(s, "")

    def trim(self, s: Column) -> Column:
        return self.trim_trailing(self.trim_leading(s))

    def trim_leading(self, s: Column) -> Column:
        return F.regexp_replace(s, f"^{self.regex}+", "")

    def trim_trailing(self, s: Column) -> Column:
        return F.regexp_replace(s, f"(?<!{self.regex}){self.regex}+\\z|^{self.regex}+\\z", "")

    def all_matches(self, s: Column) -> Column:
        return F.regexp_extract_all(s, F.lit(self.regex), F.lit(0))

    def starts(self, s: Column) -> Column:
        return s.rlike("^" + self.regex)


def _literal(to: str) -> str:
    return to.replace("\\", "\\\\").replace("$", "\\$")


def any_char() -> CharClass:
    return CharClass("\\x{0}-\\x{10FFFF}")


def no_char() -> CharClass:
    return CharClass("a&&[^a]")


def is_char(c: str | int) -> CharClass:
    return CharClass(_quoted(c if isinstance(c, int) else ord(c)))


def in_range(first: str, last: str) -> CharClass:
    if first > last:
        raise ValueError(f"empty range {first!r}-{last!r}")
    return CharClass(f"{_quoted(ord(first))}-{_quoted(ord(last))}")


def char_set(chars: str) -> CharClass:
    return CharClass("".join(_quoted(ord(c)) for c in sorted(set(chars)))) if chars else no_char()


def pattern(text: str) -> CharClass:
    """From "a-z0-9", "^…" for all others, and "…-[…]" for a difference."""
    negated = text.startswith("^")
    body = text[1:] if negated else text
    minus = None
    if body.endswith("]") and "-[" in body:
        body, inner = body.split("-[", 1)
        minus = pattern(inner[:-1])
    parts, i = [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            parts.append(in_range(body[i], body[i + 2]).java)
            i += 3
        else:
            parts.append(_quoted(ord(body[i])))
            i += 1
    out = CharClass("".join(parts)) if parts else no_char()
    out = out - minus if minus else out
    return ~out if negated else out


# ASCII classes. letter_or_digit takes the underscore in; white space is 9 to 13 and 32.
ASCII = CharClass("\\x{0}-\\x{7F}")
UPPER, LOWER, LETTER, DIGIT = CharClass("A-Z"), CharClass("a-z"), CharClass("A-Za-z"), CharClass("0-9")
LETTER_OR_DIGIT = CharClass("A-Za-z0-9_")
PUNCTUATION = CharClass("!-/:-@\\[-`{-~")
WHITESPACE = CharClass("\\x{9}-\\x{D}\\x{20}")

#: General categories and their groups.
CATEGORIES = "Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Cs Co Cn".split()
GROUPS = {"letter": "L", "mark": "M", "number": "N", "punctuation": "P", "symbol": "S", "separator": "Z", "other": "C"}


def category(name: str) -> CharClass:
    if name == "cased_letter":
        return CharClass("\\p{Lu}\\p{Ll}\\p{Lt}")
    if name not in CATEGORIES and name not in GROUPS:
        raise ValueError(f"no general category {name!r}")
    return CharClass(f"\\p{{{GROUPS.get(name, name)}}}")


@lru_cache(None)
def _bidi_runs() -> list[tuple[int, int, str]]:
    """(first, last, class) of the runs of code points of one bidirectional class, read once."""
    out: list[tuple[int, int, str]] = []
    for c in range(_TOP + 1):
        kind = "" if 0xD800 <= c <= 0xDFFF else unicodedata.bidirectional(chr(c))
        if out and out[-1][2] == kind:
            out[-1] = (out[-1][0], c, kind)
        else:
            out.append((c, c, kind))
    return out


#: The end of the Latin blocks.
_NEAR = 0x24F


def _items(spans) -> str:
    """Class items of spans (first, last) of code points in rising order, touching ones joined."""
    joined: list[tuple[int, int]] = []
    for a, b in spans:
        if joined and joined[-1][1] + 1 == a:
            joined[-1] = (joined[-1][0], b)
        else:
            joined.append((a, b))
    show = lambda part: "".join(_quoted(a) if a == b else f"{_quoted(a)}-{_quoted(b)}" for a, b in part)
    if len(joined) < 20:
        return show(joined)
    # Java tries span after span: the many far ones only where a character is past the near ones.
    near = [(a, min(b, _NEAR)) for a, b in joined if a <= _NEAR]
    far = [(max(a, _NEAR + 1), b) for a, b in joined if b > _NEAR]
    return show(near) + (f"[[^\\x{{0}}-{_quoted(_NEAR)}]&&[{show(far)}]]" if far else "")


#: Groups of bidirectional classes.
BIDI_GROUPS = {"strong": ("L", "R", "AL"), "weak": ("EN", "ES", "ET", "AN", "CS", "NSM", "BN"), "neutral": ("B", "S", "WS", "ON"), "explicit": ("LRE", "LRO", "RLE", "RLO", "PDF", "LRI", "RLI", "FSI", "PDI")}


@lru_cache(None)
def bidi(name: str) -> CharClass:
    """Characters of a bidirectional class such as L, R, AL, EN, WS, or of a group: strong, weak, neutral, explicit."""
    wanted = BIDI_GROUPS.get(name, (name,))
    found = _items((a, b) for a, b, kind in _bidi_runs() if kind in wanted)
    if not found:
        raise ValueError(f"no bidirectional class {name!r}")
    return CharClass(found)


#: Binary properties that Java's classes know.
_JAVA_PROPERTIES = {
    "alphabetic": "\\p{IsAlphabetic}", "ideographic": "\\p{IsIdeographic}", "letter": "\\p{IsLetter}", "lowercase": "\\p{IsLowercase}", "uppercase": "\\p{IsUppercase}", "titlecase": "\\p{IsTitlecase}", "white_space": "\\p{IsWhite_Space}",
    "control": "\\p{IsControl}", "hex_digit": "\\p{IsHex_Digit}", "join_control": "\\p{IsJoin_Control}", "noncharacter_code_point": "\\p{IsNoncharacter_Code_Point}", "assigned": "\\p{IsAssigned}",
}

# Small binary properties of the standard, as class items.
_FIXED_PROPERTIES = {
    "ascii_hex_digit": "0-9A-Fa-f",
    "dash": "\\p{Pd}\\x{2053}\\x{207B}\\x{208B}\\x{2212}",
    "quotation_mark": "\"'\\x{AB}\\x{BB}\\x{2018}-\\x{201F}\\x{2039}\\x{203A}\\x{2E42}\\x{300C}-\\x{300F}\\x{301D}-\\x{301F}\\x{FE41}-\\x{FE44}\\x{FF02}\\x{FF07}\\x{FF62}\\x{FF63}",
    "bidi_control": "\\x{61C}\\x{200E}\\x{200F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}",
    "pattern_white_space": "\\x{9}-\\x{D}\\x{20}\\x{85}\\x{200E}\\x{200F}\\x{2028}\\x{2029}",
    "variation_selector": "\\x{180B}-\\x{180D}\\x{180F}\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}",
    "regional_indicator": "\\x{1F1E6}-\\x{1F1FF}",
    "radical": "\\x{2E80}-\\x{2E99}\\x{2E9B}-\\x{2EF3}\\x{2F00}-\\x{2FD5}",
    "hyphen": "\\x{2D}\\x{AD}\\x{58A}\\x{1806}\\x{2010}\\x{2011}\\x{2E17}\\x{30FB}\\x{FE63}\\x{FF0D}\\x{FF65}",
    "ids_binary_operator": "\\x{2FF0}\\x{2FF1}\\x{2FF4}-\\x{2FFB}",
    "ids_trinary_operator": "\\x{2FF2}\\x{2FF3}",
    "logical_order_exception": "\\x{E40}-\\x{E44}\\x{EC0}-\\x{EC4}\\x{19B5}-\\x{19B7}\\x{19BA}\\x{AAB5}\\x{AAB6}\\x{AAB9}\\x{AABB}\\x{AABC}",
}


@lru_cache(None)
def binary_property(name: str) -> CharClass:
    """A binary property of the standard by its lower-case name: the JVM's own, or built from the characters that have it."""
    if name in _JAVA_PROPERTIES:
        return CharClass(_JAVA_PROPERTIES[name])
    if name in _FIXED_PROPERTIES:
        return CharClass(_FIXED_PROPERTIES[name])
    import regex

    try:
        found = regex.compile(f"\\p{{{name}}}+")
    except regex.error:
        raise ValueError(f"no binary property {name!r}") from None
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, _TOP + 1)]))
    spans = []
    for m in found.finditer(points):
        first, last = ord(m.group()[0]), ord(m.group()[-1])
        spans += [(first, 0xD7FF), (0xE000, last)] if first < 0xD800 <= last else [(first, last)]
    return CharClass(_items(spans)) if spans else no_char()


def script(name: str) -> CharClass:
    """A script by its name, as far as the JVM's Unicode version knows it."""
    return CharClass(f"\\p{{Is{name}}}")
