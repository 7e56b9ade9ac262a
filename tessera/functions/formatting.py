"""Formatting: functions from columns to strings, and their combinators."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Format = Callable[[Column], Column]


def _str(x) -> Column:
    return F.lit(x) if isinstance(x, str) else x


# -- combinators -------------------------------------------------------------------


def standard() -> Format:
    return lambda c: c.cast("string")


def literal(text: str) -> Format:
    return lambda c: F.lit(text)


def sequence(*formats: Format) -> Format:
    return lambda c: F.concat(*[f(c) for f in formats])


def switcher(cases: Sequence[tuple[Callable[[Column], Column], Format]], otherwise: Format = literal("")) -> Format:
    """The format of the first test that passes."""
    return lambda c: reduce(lambda rest, case: F.when(case[0](c), case[1](c)).otherwise(rest), reversed(list(cases)), otherwise(c))


def before(f: Format, text: str) -> Format:
    return lambda c: F.concat(F.lit(text), f(c))


def after(f: Format, text: str) -> Format:
    return lambda c: F.concat(f(c), F.lit(text))


def around(f: Format, first: str, last: str | None = None) -> Format:
    return after(before(f, first), first if last is None else last)


def where(f: Format, test: Callable[[Column], Column]) -> Format:
    return lambda c: F.when(test(c), f(c)).otherwise(F.lit(""))


def if_null(f: Format, label: str = "␀") -> Format:
    return lambda c: F.when(c.isNull(), F.lit(label)).otherwise(f(c))


def if_empty(f: Format, label: str = "∅") -> Format:
    """For arrays."""
    return lambda c: F.when(F.size(c) == 0, F.lit(label)).otherwise(f(c))


def on_result_of(f: Format, derive: Callable[[Column], Column]) -> Format:
    return lambda c: f(derive(c))


def iterable(f: Format = standard(), separator: str = ", ", last_separator: str | None = None, leading: int | None = None, trailing: int | None = None, ellipsis: str = "…", before: str = "", after: str = "", empty: str = "") -> Format:
    """An array's items; with limits only the first and last of them around an ellipsis."""

    def run(c: Column) -> Column:
        items = F.transform(c, f)
        n = F.size(items)
        if leading is not None or trailing is not None:
            a, b = leading or 0, trailing or 0
            cut = F.concat(F.slice(items, F.lit(1), F.lit(a)), F.array(F.lit(ellipsis)), F.slice(items, F.greatest(n - b, F.lit(0)) + 1, F.lit(b)))
            items = F.when(n > a + b, cut).otherwise(items)
        if last_separator is None:
            body = F.array_join(items, separator)
        else:
            m = F.size(items)
            body = F.when(m > 1, F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(m - 1, F.lit(0))), separator), F.lit(last_separator), F.element_at(items, -1))).otherwise(F.array_join(items, separator))
        return F.when(n == 0, F.lit(empty)).otherwise(F.concat(F.lit(before), body, F.lit(after)))

    return run


# -- strings -----------------------------------------------------------------------


def pad_left(s: Column, width: int, padding: str = " ") -> Column:
    """At least so wide; never cut."""
    return F.when(F.length(s) < width, F.lpad(s, width, padding)).otherwise(s)


def pad_right(s: Column, width: int, padding: str = " ") -> Column:
    return F.when(F.length(s) < width, F.rpad(s, width, padding)).otherwise(s)


def pad_both(s: Column, width: int, padding: str = " ") -> Column:
    """Padded on either side, the odd one on the right."""
    left = F.length(s) + F.floor((F.lit(width) - F.length(s)) / 2)
    return F.when(F.length(s) < width, F.rpad(F.lpad(s, left.cast("int"), F.lit(padding)), width, padding)).otherwise(s)


def separate_right(s: Column, width: int, offset: int, separator: str) -> Column:
    """A separator after every ``width`` characters counted from the right; the first group is shorter by ``offset``."""
    first = width - offset if offset else width
    n = F.length(s)
    cuts = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: (i == 1) | ((n - i + 1 - first >= 0) & ((n - i + 1 - first) % width == 0)))
    ends = F.zip_with(cuts, F.slice(F.concat(cuts, F.array(n + 1)), F.lit(2), F.size(cuts)), lambda a, b: F.substring(s, a, b - a))
    return F.array_join(ends, separator)


def separate_left(s: Column, width: int, offset: int, separator: str) -> Column:
    return F.reverse(separate_right(F.reverse(s), width, offset, separator[::-1]))


def truncate_right(s: Column, width: int, ellipsis: str = "…", method: str = "characters") -> Column:
    """Cut to ``width`` with an ellipsis; after whole words or sentences if asked for."""
    room = max(0, width - len(ellipsis))
    head = F.substring(s, 1, room)
    if method == "words":
        head = F.regexp_replace(F.substring(s, 1, room + 1), r"\s*\S*\z", "")
    elif method == "sentences":
        head = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    elif method != "characters":
        raise ValueError("method must be characters, words or sentences")
    return F.when(F.length(s) > width, F.concat(head, F.lit(ellipsis))).otherwise(s)


def truncate_left(s: Column, width: int, ellipsis: str = "…") -> Column:
    room = max(0, width - len(ellipsis))
    return F.when(F.length(s) > width, F.concat(F.lit(ellipsis), F.substring(s, F.length(s) - room + 1, F.lit(room)))).otherwise(s)


def truncate_center(s: Column, width: int, ellipsis: str = "…") -> Column:
    room = max(0, width - len(ellipsis))
    a, b = (room + 1) // 2, room // 2
    return F.when(F.length(s) > width, F.concat(F.substring(s, 1, a), F.lit(ellipsis), F.substring(s, F.length(s) - b + 1, F.lit(b)))).otherwise(s)


def trim(s: Column, left: bool = True, right: bool = True) -> Column:
    """White space of the standard."""
    space = r"\p{IsWhite_Space}"
    s = F.regexp_replace(s, f"^{space}+", "") if left else s
    return F.regexp_replace(s, rf"(?<!{space}){space}+\z|^{space}+\z", "") if right else s


# -- numbers -----------------------------------------------------------------------


def sign(x: Column, negative: str = "-", positive: str = "") -> Column:
    """Positive "" to leave the sign out, "+" or " " to show it."""
    return F.when(x < 0, F.lit(negative)).otherwise(F.lit(positive))


def _numerals() -> dict[str, int]:
    """Starts of all decimal digits of the standard, by their names: ten in a row from each digit zero on."""
    found = {"latin": 0x30}
    for c in range(0x80, 0x110000):
        if unicodedata.decimal(chr(c), None) == 0 and unicodedata.category(chr(c)) == "Nd":
            name = unicodedata.name(chr(c)).removesuffix(" ZERO").removesuffix(" DIGIT").lower()
            found[name.replace("mathematical ", "").replace("-", "_").replace(" ", "_")] = c
    # Shorter names of some.
    return found | {"arabic": 0x660, "extended_arabic": 0x6F0, "segmented": 0x1FBF0}


NUMERALS = _numerals()


def numerals(s: Column, system: str) -> Column:
    """Decimal digits in another script."""
    return F.translate(s, "0123456789", "".join(chr(NUMERALS[system] + i) for i in range(10)))


def fixed(x: Column, precision: int = 0, base: int = 10, padding: int = 0, separator: str = "", width: int = 3, positive: str = "", accuracy: float | None = None, delimiter: str = ".", nan: str = "NaN", infinity: str = "Infinity") -> Column:
    """Fixed point, rounded half away from zero; grouped by ``separator`` every ``width`` digits.

    The sign is the number's own before it is rounded, that of negative zero too.
    """
    value = x.cast("double")
    if accuracy is not None:
        value = F.signum(value) * F.floor(F.abs(value) / accuracy + 0.5) * accuracy
        precision = max(precision, 0, -math.floor(math.log10(accuracy))) if accuracy < 1 else precision
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    safe = F.when(finite, F.abs(value)).otherwise(F.lit(0.0))
    scaled = F.round(safe * F.lit(float(base**precision)), 0).cast("decimal(38,0)")
    unit = F.lit(base**precision).cast("decimal(38,0)")
    whole, part = F.call_function("div", scaled, unit).cast("decimal(38,0)"), (scaled % unit).cast("decimal(38,0)")
    show = (lambda n: n.cast("string")) if base == 10 else (lambda n: F.lower(F.conv(n.cast("string"), 10, base)))
    digits = pad_left(show(whole), padding, "0") if padding else show(whole)
    digits = separate_right(digits, width, 0, separator) if separator else digits
    tail = F.concat(F.lit(delimiter), pad_left(show(part), precision, "0")) if precision else F.lit("")
    below = (value < 0) | ((value == 0) & F.startswith(value.cast("string"), F.lit("-")))
    text = F.concat(F.when(below, F.lit("-")).otherwise(F.lit(positive)), digits, tail)
    return F.when(F.isnan(value), F.lit(nan)).when(value == F.lit(float("inf")), F.lit(positive + infinity)).when(value == F.lit(float("-inf")), F.lit("-" + infinity)).otherwise(text)


def scientific(x: Column, precision: int = 3, significant: int = 1, marker: str = "e") -> Column:
    """Mantissa with ``significant`` digits before the point, and exponent; rounded half away from zero.

    Works on the decimal digits that the number shows, so no power of ten is
    divided by and ties are ties.
    """
    value = x.cast("double")
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    shown = F.abs(value).cast("string")  # 2488.5, 1.0E-10
    plain, power = F.substring_index(shown, "E", 1), F.when(shown.contains("E"), F.substring_index(shown, "E", -1).cast("int")).otherwise(F.lit(0))
    before = F.substring_index(plain, ".", 1)
    every = F.concat(before, F.when(plain.contains("."), F.substring_index(plain, ".", -1)).otherwise(F.lit("")))
    digits = F.regexp_replace(every, "^0+", "")
    first = F.length(before) - 1 - (F.length(every) - F.length(digits)) + power  # the exponent of the first digit
    keep = precision + significant
    padded = F.rpad(digits, keep + 1, "0")
    head = F.substring(padded, 1, keep).cast("decimal(38,0)") + F.when(F.substring(padded, keep + 1, 1) >= "5", 1).otherwise(0)
    over = head >= F.lit(10**keep).cast("decimal(38,0)")
    head = F.when(over, F.lit(10 ** (keep - 1)).cast("decimal(38,0)")).otherwise(head)
    exponent = F.when(over, first + 1).otherwise(first) - (significant - 1)
    unit = F.lit(10**precision).cast("decimal(38,0)")
    tail = F.concat(F.lit("."), pad_left((head % unit).cast("decimal(38,0)").cast("string"), precision, "0")) if precision else F.lit("")
    text = F.concat(sign(value), F.call_function("div", head, unit).cast("string"), tail, F.lit(marker), exponent.cast("string"))
    zero = F.concat(F.lit("0" + ("." + "0" * precision if precision else "") + marker + "0"))
    return F.when(~finite, fixed(value)).when(value == 0, zero).otherwise(text)


# Unit prefixes of powers of 1000 and of 1024.
DECIMAL_UNITS = "q r y z a f p n μ m  k M G T P E Z Y R Q".split(" ")
BINARY_UNITS = " Ki Mi Gi Ti Pi Ei Zi Yi".split(" ")


def human(x: Column, unit: str = "", precision: int = 1, binary: bool = False, unit_precision: int = 0, separator: str = " ") -> Column:
    """With the largest unit prefix that keeps the number at 1 or above; numbers without a prefix get ``unit_precision``."""
    value = x.cast("double")
    base, prefixes = (1024.0, BINARY_UNITS) if binary else (1000.0, DECIMAL_UNITS)
    zero = prefixes.index("")
    size = F.abs(value)
    out = None
    for k in range(-zero, len(prefixes) - zero):
        name = prefixes[k + zero]
        text = fixed(value / F.lit(base**k), precision if k else unit_precision)
        suffix = f"{separator}{name}{unit}" if name or unit else ""
        made = F.concat(text, F.lit(suffix))
        out = made if out is None else F.when(size >= base**k, made).otherwise(out)
    plain = F.concat(fixed(size, unit_precision), F.lit(f"{separator}{unit}" if unit else ""))
    return F.when(size == 0, plain).otherwise(out)


def ordinal(x: Column) -> Column:
    """1st, 2nd, 3rd, 4th; th from 10 to 20 of each hundred."""
    n = F.abs(x)
    ending = F.when((n % 100 >= 10) & (n % 100 <= 20), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(x.cast("string"), ending)


def code_point(x: Column) -> Column:
    """U+0041 "A"."""
    return F.concat(F.lit("U+"), pad_left(F.hex(x.cast("long")), 4, "0"), F.lit(' "'), F.when(x < 128, F.chr(x)).otherwise(F.decode(F.unhex(F.lpad(F.hex(x.cast("long")), 8, "0")), "UTF-32")), F.lit('"'))


# -- dates, durations, objects -----------------------------------------------------


def iso8601(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def date(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd")


def time(t: Column) -> Column:
    return F.date_format(t, "HH:mm:ss")


def date_time(*parts: str | Format) -> Format:
    """Literals and parts in a row: date_time(year(), "-", month())."""
    made = [literal(p) if isinstance(p, str) else p for p in parts]
    return sequence(*made)


def _field(extract: Callable[[Column], Column], width: int = 0) -> Format:
    return lambda t: pad_left(extract(t).cast("string"), width, "0") if width else extract(t).cast("string")


def era(before: str = "BC", after: str = "AD") -> Format:
    return lambda t: F.when(F.year(t) <= 0, before).otherwise(F.lit(after))


def year(width: int = 4) -> Format:
    return _field(F.year, width)


def quarter() -> Format:
    return _field(F.quarter)


def month(width: int = 2, names: Sequence[str] | None = None) -> Format:
    return (lambda t: F.element_at(F.array(*[F.lit(n) for n in names]), F.month(t))) if names else _field(F.month, width)


def weekday(names: Sequence[str] | None = None) -> Format:
    """Monday is 1, or the first name."""
    return (lambda t: F.element_at(F.array(*[F.lit(n) for n in names]), F.weekday(t) + 1)) if names else _field(lambda t: F.weekday(t) + 1)


def week(width: int = 2) -> Format:
    return _field(F.weekofyear, width)


def day(width: int = 2) -> Format:
    return _field(F.dayofmonth, width)


def day_of_year(width: int = 3) -> Format:
    return _field(F.dayofyear, width)


def meridiem(am: str = "am", pm: str = "pm") -> Format:
    return lambda t: F.when(F.hour(t) < 12, am).otherwise(F.lit(pm))


def hour(width: int = 2) -> Format:
    return _field(F.hour, width)


def hour12(width: int = 2) -> Format:
    return _field(lambda t: (F.hour(t) + 11) % 12 + 1, width)


def minute(width: int = 2) -> Format:
    return _field(F.minute, width)


def second(width: int = 2) -> Format:
    return _field(F.second, width)


def millisecond(width: int = 3) -> Format:
    return lambda t: F.substring(F.date_format(t, "SSSSSS"), 1, width)


def microsecond(width: int = 3) -> Format:
    return lambda t: F.substring(F.date_format(t, "SSSSSS"), 4, width)


def duration(us: Column) -> Column:
    """[-]h:mm:ss.ffffff."""
    n = F.abs(us.cast("long"))
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
    two = lambda x: pad_left(x.cast("string"), 2, "0")
    return F.concat(sign(us), div(n, 3_600_000_000).cast("string"), F.lit(":"), two(div(n, 60_000_000) % 60), F.lit(":"), two(div(n, 1_000_000) % 60), F.lit("."), pad_left((n % 1_000_000).cast("string"), 6, "0"))


def duration_iso8601(us: Column) -> Column:
    """P1DT2H3M4.5S with zero parts left out; PT0S for nothing."""
    n = F.abs(us.cast("long"))
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
    part = lambda v, letter: F.when(v > 0, F.concat(v.cast("string"), F.lit(letter))).otherwise(F.lit(""))
    rest = n % 60_000_000
    frac = F.regexp_replace(pad_left((rest % 1_000_000).cast("string"), 6, "0"), "0+$", "")
    secs = F.when(rest > 0, F.concat(div(rest, 1_000_000).cast("string"), F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(F.lit("")), F.lit("S"))).otherwise(F.lit(""))
    clock = F.concat(part(div(n, 3_600_000_000) % 24, "H"), part(div(n, 60_000_000) % 60, "M"), secs)
    body = F.concat(part(div(n, 86_400_000_000), "D"), F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise(F.lit("")))
    return F.concat(sign(us), F.lit("P"), F.when(body == "", F.lit("T0S")).otherwise(body))


def record(name: str, fields: dict[str, Column], omit_null: bool = False, separator: str = ", ", assign: str = "=") -> Column:
    """Name(a=1, b=2); null fields shown or left out."""
    shown = [F.when(c.isNotNull(), F.concat(F.lit(k + assign), c.cast("string"))).otherwise(F.lit(None) if omit_null else F.lit(f"{k}{assign}null")) for k, c in fields.items()]
    return F.concat(F.lit(name + "("), F.concat_ws(separator, *shown), F.lit(")"))
