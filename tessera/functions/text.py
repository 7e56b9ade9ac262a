"""String functions. Lengths and places count code points unless a name says graphemes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.plans.checks import non_negative, positive
from tessera.plans.expr import let

#: White space of the standard, for Java's regular expressions.
SPACE = r"\p{IsWhite_Space}"


def _empty_strings() -> Column:
    return F.array().cast("array<string>")


def chunked(s: Column, size: int) -> Column:
    """Pieces of ``size`` code points; the last may be shorter."""
    positive(size, "size")
    starts = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(s, i, F.lit(size)))


def graphemes(s: Column) -> Column:
    """Grapheme clusters, by the JVM's own segmentation."""
    return F.regexp_extract_all(s, F.lit(r"(?s)\X"), F.lit(0))


def graphemes_chunked(s: Column, size: int) -> Column:
    positive(size, "size")
    g = graphemes(s)
    starts = F.when(F.size(g) > 0, F.sequence(F.lit(1), F.size(g), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(g, i, F.lit(size)), ""))


def characters(s: Column) -> Column:
    """The code points as strings."""
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.when(s.isNotNull(), _empty_strings()))


def convert_first(s: Column, function, count: int = 1) -> Column:
    """function applied to the first ``count`` graphemes; shorter strings stay."""
    g = graphemes(s)
    made = F.concat(function(F.array_join(F.slice(g, 1, positive(count, "count")), "")), F.array_join(F.slice(g, F.lit(count + 1), F.size(g)), ""))
    return F.when(F.size(g) >= count, made).otherwise(s)


def convert_last(s: Column, function, count: int = 1) -> Column:
    g = graphemes(s)
    n = F.size(g)
    made = F.concat(F.array_join(F.slice(g, F.lit(1), F.greatest(n - positive(count, "count"), F.lit(0))), ""), function(F.array_join(F.slice(g, F.greatest(n - count, F.lit(0)) + 1, F.lit(count)), "")))
    return F.when(n >= count, made).otherwise(s)


def upper_first(s: Column) -> Column:
    return convert_first(s, F.upper)


def lower_first(s: Column) -> Column:
    return convert_first(s, F.lower)


def indent(s: Column, prefix: str, first_prefix: str | None = None, trim: bool = True, empty: bool = False) -> Column:
    """A prefix before each line; lines are trimmed first unless asked not to, empty ones skipped unless asked for."""

    def line(x: Column, i: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(x, f"^{SPACE}+", ""), f"(?<!{SPACE}){SPACE}+\\z", "") if trim else x
        own = F.when(i == 0, F.lit(first_prefix)).otherwise(F.lit(prefix)) if first_prefix is not None else F.lit(prefix)
        return F.concat(own, body) if empty else F.when(body != "", F.concat(own, body)).otherwise(body)

    return F.array_join(F.transform(F.split(s, "\n"), line), "\n")


def dedent(s: Column, ignore_empty: bool = True) -> Column:
    """Without the longest white-space prefix common to all lines (blank ones aside if ignored)."""

    def prefix(lines: Column) -> Column:
        counted = F.filter(lines, lambda x: F.regexp_replace(x, f"{SPACE}+", "") != "") if ignore_empty else lines
        starts = F.transform(counted, lambda x: F.regexp_extract(x, f"^{SPACE}*", 0))
        # what the first and the last in sorted order share, all share
        return let(F.struct(F.array_min(starts).alias("lo"), F.array_max(starts).alias("hi")), lambda v: F.coalesce(F.substring(v["lo"], F.lit(1), common(v["lo"], v["hi"])), F.lit("")))

    def common(low: Column, high: Column) -> Column:
        places = F.when(F.length(low) > 0, F.sequence(F.lit(1), F.length(low))).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(places, lambda i: F.substring(low, F.lit(1), i) == F.substring(high, F.lit(1), i)))

    def cut(v: Column) -> Column:
        bare = lambda x: F.when(F.startswith(x, v["p"]), F.substring(x, F.length(v["p"]) + 1, F.length(x))).otherwise(F.regexp_replace(x, f"^{SPACE}+", ""))
        return F.array_join(F.transform(v["l"], bare), "\n")

    return let(F.split(s, "\n"), lambda lines: let(F.struct(lines.alias("l"), prefix(lines).alias("p")), cut))


def partition(s: Column, separator: str) -> Column:
    """[before, separator, after] at the first separator, or [s, "", ""]."""
    at = F.locate(separator, s)
    return F.when(at > 0, F.array(F.substring(s, F.lit(1), at - 1), F.lit(separator), F.substring(s, at + len(separator), F.length(s)))).otherwise(F.array(s, F.lit(""), F.lit("")))


def last_partition(s: Column, separator: str) -> Column:
    """[before, separator, after] at the last separator, or ["", "", s]."""
    found = F.locate(separator[::-1], F.reverse(s))
    at = F.length(s) - found - len(separator) + 2
    return F.when(found > 0, F.array(F.substring(s, F.lit(1), at - 1), F.lit(separator), F.substring(s, at + len(separator), F.length(s)))).otherwise(F.array(F.lit(""), F.lit(""), s))


def remove_prefix(s: Column, prefix: str) -> Column:
    return F.when(F.startswith(s, F.lit(prefix)), F.substring(s, F.lit(len(prefix) + 1), F.length(s))).otherwise(s)


def remove_suffix(s: Column, suffix: str) -> Column:
    return F.when(F.endswith(s, F.lit(suffix)), F.substring(s, F.lit(1), F.length(s) - len(suffix))).otherwise(s)


def take(s: Column, n: int) -> Column:
    return F.substring(s, 1, non_negative(n, "n"))


def take_last(s: Column, n: int) -> Column:
    return F.substring(s, F.greatest(F.length(s) - non_negative(n, "n"), F.lit(0)) + 1, F.lit(n))


def skip(s: Column, n: int) -> Column:
    return F.substring(s, F.lit(non_negative(n, "n") + 1), F.length(s))


def skip_last(s: Column, n: int) -> Column:
    return F.substring(s, F.lit(1), F.greatest(F.length(s) - non_negative(n, "n"), F.lit(0)))


def take_to(s: Column, separator: str) -> Column:
    """Before the first separator; all if there is none."""
    at = F.locate(separator, s)
    return F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(s)


def take_last_to(s: Column, separator: str) -> Column:
    """After the last separator; all if there is none."""
    parts = last_partition(s, separator)
    return parts[2]


def skip_to(s: Column, separator: str) -> Column:
    """After the first separator; nothing if there is none."""
    at = F.locate(separator, s)
    return F.when(at > 0, F.substring(s, at + len(separator), F.length(s))).otherwise(F.when(s.isNotNull(), F.lit("")))


def skip_last_to(s: Column, separator: str) -> Column:
    """Before the last separator; nothing if there is none."""
    return last_partition(s, separator)[0]


def unwrap(s: Column) -> Column:
    """Single line ends become spaces; blank lines keep paragraphs apart."""
    paragraphs = F.split(s, r"\n(?:[^\S\n]*\n)+")
    return F.array_join(F.transform(paragraphs, lambda p: F.regexp_replace(p, "\n", " ")), "\n\n")


@F.pandas_udf(T.StringType())
def _wrap(s: pd.Series, width: pd.Series, whole: pd.Series) -> pd.Series:
    def one(text, n, broken):
        if text is None:
            return None
        out = []
        for line in text.split("\n"):
            now = ""
            for word in line.split():
                while broken and len(word) > n and (not now or len(now) + 1 + len(word) > n):
                    if now:
                        out.append(now)
                        now = ""
                    out.append(word[:n])
                    word = word[n:]
                if not word:
                    continue
                if now and len(now) + 1 + len(word) > n:
                    out.append(now)
                    now = ""
                now = f"{now} {word}" if now else word
            out.append(now)
        return "\n".join(out)

    return pd.Series([one(*x) for x in zip(s, width, whole)])


def wrap(s: Column, width: int, break_long: bool = True) -> Column:
    """Each line filled anew up to ``width``; words longer than it are broken or stand alone."""
    return _wrap(s, F.lit(positive(width, "width")), F.lit(break_long))


#: Texts of an Arrow batch that are Python strings at once.
AT_ONCE = 64


def _by_text(work: Callable[[str], object], made: T.DataType):
    """A function of texts on Arrow arrays. A batch has 10,000 texts of any length, so only a few leave Arrow at a time."""
    kind = to_arrow_type(made)

    @F.arrow_udf(made)
    def run(x: pa.Array) -> pa.Array:
        parts = [pa.array([None if v is None else work(v) for v in x.slice(k, AT_ONCE).to_pylist()], kind) for k in range(0, len(x), AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run


def _ascii(s: Column) -> Column:
    return F.octet_length(s) == F.length(s)


def _form(name: str) -> str:
    if name not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"no normal form {name!r}")
    return name


def normalize(s: Column, form: str = "NFC", *then: str) -> Column:
    """A Unicode normal form, and others of it in the same pass; ASCII texts never leave the JVM."""
    forms = [_form(f) for f in (form, *then)]
    run = _by_text(lambda v: reduce(lambda now, f: unicodedata.normalize(f, now), forms, v), T.StringType())
    return F.when(_ascii(s), s).otherwise(run(F.when(~_ascii(s), s)))


def normal_form_settled(s: Column, form: str = "NFC") -> Column:
    """Whether a text's normal form is its own normal form; neither form leaves the Python worker."""
    form = _form(form)

    def settled(v: str) -> bool:
        once = unicodedata.normalize(form, v)
        return unicodedata.normalize(form, once) == once

    run = _by_text(settled, T.BooleanType())
    return F.when(_ascii(s), F.lit(True)).otherwise(run(F.when(~_ascii(s), s)))


def with_prefix(key: Column, prefix: str) -> Column:
    """The test of a prefix scan; order by the key for its order."""
    return F.startswith(key, F.lit(prefix))
