"""Queries on strings and character classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import charclass as cc
from tessera.functions import text
from tessera.plans.registry import query

def _docs(t):
    return t.documents.select("doc_id", "text")


def _join(c):
    return F.array_join(c, "|")


@query("text_chunked", "select p_partkey, array_to_string([substr(p_name, cast(i as bigint), 4) for i in range(1, length(p_name) + 1, 4)], '|') as pieces from part")
def _(t):
    return t.part.select("p_partkey", _join(text.chunked(F.col("p_name"), 4)).alias("pieces"))


@query("text_graphemes", "select p_partkey, array_to_string([substr(p_name, cast(i as bigint), 4) for i in range(1, length(p_name) + 1, 4)], '|') as pieces, length(p_name) as n from part")
def _(t):
    c = F.col("p_name")
    return t.part.select("p_partkey", _join(text.graphemes_chunked(c, 4)).alias("pieces"), F.size(text.graphemes(c)).cast("long").alias("n"))


@query("text_convert_ends", "select p_partkey, upper(p_name[1]) || p_name[2:] as first, p_name[:-3] || upper(p_name[-2:]) as last, lower(p_brand[1]) || p_brand[2:] as lowered from part")
def _(t):
    return t.part.select("p_partkey", text.upper_first(F.col("p_name")).alias("first"), text.convert_last(F.col("p_name"), F.upper, 2).alias("last"), text.lower_first(F.col("p_brand")).alias("lowered"))


@query("text_indent", "select doc_id, array_to_string([case when x = '' then '' else '> ' || x end for x in [trim(y) for y in string_split(text, chr(10))]], chr(10)) as out from documents")
def _(t):
    return _docs(t).select("doc_id", text.indent(F.col("text"), "> ").alias("out"))


@query("text_dedent", "select doc_id, text as out from documents")
def _(t):
    return _docs(t).select("doc_id", text.dedent(F.concat(F.lit("   "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n   ")))).alias("out"))


@query("text_partition", "select p_partkey, string_split(p_name, ' ')[1] as head, case when contains(p_name, ' ') then ' ' else '' end as mark, case when contains(p_name, ' ') then substr(p_name, instr(p_name, ' ') + 1) else '' end as tail, string_split(p_brand, '#')[-1] as last from part")
def _(t):
    p = text.partition(F.col("p_name"), " ")
    return t.part.select("p_partkey", p[0].alias("head"), p[1].alias("mark"), p[2].alias("tail"), text.last_partition(F.col("p_brand"), "#")[2].alias("last"))


@query("text_prefix_suffix", "select c_custkey, case when starts_with(c_name, 'Customer#') then substr(c_name, 10) else c_name end as bare, case when ends_with(c_name, '1') then c_name[:-2] else c_name end as cut from customer")
def _(t):
    c = F.col("c_name")
    return t.customer.select("c_custkey", text.remove_prefix(c, "Customer#").alias("bare"), text.remove_suffix(c, "1").alias("cut"))


@query("text_take_skip", """select p_partkey, left(p_name, 3) as take, right(p_name, 3) as take_last, substr(p_name, 4) as skip, left(p_name, greatest(length(p_name) - 3, 0)) as skip_last,
 case when contains(p_name, 'a') then left(p_name, instr(p_name, 'a') - 1) else p_name end as take_to, string_split(p_name, 'a')[-1] as take_last_to,
 case when contains(p_name, 'a') then substr(p_name, instr(p_name, 'a') + 1) else '' end as skip_to, case when contains(p_name, 'a') then left(p_name, length(p_name) - instr(reverse(p_name), 'a')) else '' end as skip_last_to from part""")
def _(t):
    c = F.col("p_name")
    f = {"take": text.take(c, 3), "take_last": text.take_last(c, 3), "skip": text.skip(c, 3), "skip_last": text.skip_last(c, 3), "take_to": text.take_to(c, "a"), "take_last_to": text.take_last_to(c, "a"), "skip_to": text.skip_to(c, "a"), "skip_last_to": text.skip_last_to(c, "a")}
    return t.part.select("p_partkey", *[v.alias(k) for k, v in f.items()])


@query("text_unwrap", "select doc_id, array_to_string([replace(p, chr(10), ' ') for p in string_split_regex(text, '\\n(?:[^\\S\\n]*\\n)+')], chr(10) || chr(10)) as out from documents")
def _(t):
    return _docs(t).select("doc_id", text.unwrap(F.col("text")).alias("out"))


@query("text_wrap", r"""select conv_id, turn, array_to_string([coalesce(list_reduce([w for w in string_split_regex(line, '\s+') if w <> ''], lambda acc, w: acc || case when length(regexp_extract(acc, '[^\n]*$')) + 1 + length(w) > 40 then chr(10) else ' ' end || w), '') for line in string_split(text, chr(10))], chr(10)) as out from conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", text.wrap(F.col("text"), 40).alias("out"))


@query("text_normalize", "select doc_id, nfc_normalize(text) as nfc from documents")
def _(t):
    return _docs(t).select("doc_id", text.normalize(text.normalize(F.col("text"), "NFD"), "NFC").alias("nfc"))


@query("text_normal_forms", "select doc_id, nfc_normalize(text) as nfc, nfc_normalize(text) as nfc_of_nfd, nfc_normalize(lower(text)) as nfc_of_nfkd_lower, true as nfd_settled, true as nfkc_settled, strip_accents(lower(text)) as bare from documents")
def _(t):
    """The forms by what holds between them; the texts' letters have no other compatible forms than their own."""
    c, n, settled = F.col("text"), text.normalize, text.normal_form_settled
    bare = F.regexp_replace(n(F.lower(c), "NFD"), r"\p{Mn}+", "")
    return _docs(t).select("doc_id", n(c, "NFC").alias("nfc"), n(c, "NFD", "NFC").alias("nfc_of_nfd"), n(F.lower(c), "NFKD", "NFC").alias("nfc_of_nfkd_lower"), settled(c, "NFD").alias("nfd_settled"), settled(c, "NFKC").alias("nfkc_settled"), bare.alias("bare"))


@query("text_characters", "select p_partkey, array_to_string(string_split(p_brand, ''), '|') as chars from part")
def _(t):
    return t.part.select("p_partkey", _join(text.characters(F.col("p_brand"))).alias("chars"))


@query("trie_prefix_scan", "select p_name, p_partkey from part where starts_with(p_name, 'b') order by p_name, p_partkey")
def _(t):
    return t.part.where(text.with_prefix(F.col("p_name"), "b")).select("p_name", "p_partkey").orderBy("p_name", "p_partkey")


@query("trie_edit", "select p_partkey as k, case when p_partkey = 3 then 'three' else p_name end as v from part where p_partkey not in (5, 6) union all select -1, 'new'")
def _(t):
    from tessera.operators import bags

    base = t.part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v"))
    spark = t.spark
    put = spark.range(1).select(F.expr("inline(array(struct(3L as k, 'three' as v), struct(-1L as k, 'new' as v)))"))
    return bags.multimap_remove(bags.multimap_replace(base, put, "k"), spark.range(5, 7).select(F.col("id").alias("k")), "k")


@query("chars_count_edit", r"""select doc_id, cast(len(regexp_extract_all(text, '[aeiou]')) as integer) as vowels, regexp_replace(text, '[aeiou]', '', 'g') as removed, regexp_replace(text, '[^a-z]', '', 'g') as kept,
 regexp_replace(text, '[\t-\r ]+', '_', 'g') as collapsed, regexp_replace(text, '[0-9]', '$', 'g') as replaced from documents""")
def _(t):
    v = cc.char_set("aeiou")
    return _docs(t).select("doc_id", v.count(F.col("text")).alias("vowels"), v.remove(F.col("text")).alias("removed"), cc.LOWER.retain(F.col("text")).alias("kept"), cc.WHITESPACE.collapse(F.col("text"), "_").alias("collapsed"), cc.DIGIT.replace(F.col("text"), "$").alias("replaced"))


@query("chars_find", r"""select p_partkey, case when regexp_matches(p_name, '[m-z]') then length(regexp_extract(p_name, '^[^m-z]*')) else -1 end as first, case when regexp_matches(p_name, '[m-z]') then length(p_name) - 1 - length(regexp_extract(p_name, '[^m-z]*$')) else -1 end as last,
 array_to_string(regexp_extract_all(p_name, '[m-z]'), '|') as matches, regexp_matches(p_name, '^[a-z]') as starts from part""")
def _(t):
    c, m = F.col("p_name"), cc.in_range("m", "z")
    return t.part.select("p_partkey", m.first_index(c).cast("long").alias("first"), m.last_index(c).cast("long").alias("last"), _join(m.all_matches(c)).alias("matches"), cc.LOWER.starts(c).alias("starts"))


@query("chars_trim", r"""select p_partkey, regexp_replace(regexp_replace(p_brand, '^[A-Za-z]+', ''), '[0-9]+$', '') as both, regexp_replace(p_brand, '^[A-Za-z]+', '') as leading, regexp_replace(p_brand, '[0-9]+$', '') as trailing from part""")
def _(t):
    c = F.col("p_brand")
    return t.part.select("p_partkey", cc.DIGIT.trim_trailing(cc.LETTER.trim_leading(c)).alias("both"), cc.LETTER.trim_leading(c).alias("leading"), cc.DIGIT.trim_trailing(c).alias("trailing"))


@query("chars_tests", r"""select doc_id, regexp_full_match(text, '[\x00-\x7F]*') as ascii, regexp_matches(text, '[0-9]') as digit, not regexp_matches(text, '[A-Z]') as no_upper, regexp_matches(text, '[!-/:-@\[-`{-~]') as punctuation, regexp_matches(text, '[A-Za-z0-9_]') as word from documents""")
def _(t):
    return _docs(t).select("doc_id", cc.ASCII.every_of(F.col("text")).alias("ascii"), cc.DIGIT.any_of(F.col("text")).alias("digit"), cc.UPPER.none_of(F.col("text")).alias("no_upper"), cc.PUNCTUATION.any_of(F.col("text")).alias("punctuation"), cc.LETTER_OR_DIGIT.any_of(F.col("text")).alias("word"))


@query("chars_algebra", r"""select doc_id, cast(len(regexp_extract_all(text, '[bcdfghjklmnpqrstvwxyz]')) as integer) as consonants, cast(len(regexp_extract_all(text, '[a-z0-9]')) as integer) as lower_or_digit, cast(len(regexp_extract_all(text, '[^a-z]')) as integer) as others, 0 as none, cast(length(text) as integer) as every from documents""")
def _(t):
    return _docs(t).select(
        "doc_id", cc.pattern("a-z-[aeiou]").count(F.col("text")).alias("consonants"), (cc.LOWER | cc.DIGIT).count(F.col("text")).alias("lower_or_digit"), cc.pattern("^a-z").count(F.col("text")).alias("others"), (cc.no_char() | (cc.LOWER & cc.UPPER)).count(F.col("text")).alias("none"), (cc.any_char() & ~cc.no_char()).count(F.col("text")).alias("every")
    )


@query("chars_categories", r"""select doc_id, cast(len(regexp_extract_all(text, '\p{Lu}')) as integer) as lu, cast(len(regexp_extract_all(text, '\p{L}')) as integer) as letters, cast(len(regexp_extract_all(text, '\p{N}')) as integer) as numbers, cast(len(regexp_extract_all(text, '\p{P}')) as integer) as marks, cast(len(regexp_extract_all(text, '\p{S}')) as integer) as symbols from documents""")
def _(t):
    return _docs(t).select("doc_id", *[cc.category(c).count(F.col("text")).alias(n) for n, c in (("lu", "Lu"), ("letters", "letter"), ("numbers", "number"), ("marks", "punctuation"), ("symbols", "symbol"))])


@query("chars_scripts", r"""select doc_id, cast(len(regexp_extract_all(text, '\p{Latin}')) as integer) as latin, cast(len(regexp_extract_all(text, '\p{Greek}')) as integer) as greek, cast(len(regexp_extract_all(text, '[0-9A-Fa-f]')) as integer) as hexa, cast(len(regexp_extract_all(text, '[\t-\r ]')) as integer) as white from documents""")
def _(t):
    return _docs(t).select("doc_id", cc.script("Latin").count(F.col("text")).alias("latin"), cc.script("Greek").count(F.col("text")).alias("greek"), cc.binary_property("ascii_hex_digit").count(F.col("text")).alias("hexa"), cc.binary_property("white_space").count(F.col("text")).alias("white"))


_BIDI = {"l": r"\p{L}", "en": "[0-9]", "ws": r"[ \x0c]", "es": "[+-]", "et": "[#$%]", "cs": "[,./:]", "strong": r"\p{L}", "weak": r"[0-9+#$%,./:\-]", "neutral": r"[ \t\n\x0b-\x0d!\"&'()*;<=>?@\[\\\]^_`{|}~]", "explicit": r"[\x{202A}-\x{202E}]"}


@query("chars_bidi", "select doc_id, " + ", ".join(f"cast(len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) as integer) as {n}" for n, p in _BIDI.items()) + " from documents")
def _(t):
    names = {n: n if n in cc.BIDI_GROUPS else n.upper() for n in _BIDI}
    return _docs(t).select("doc_id", *[cc.bidi(b).count(F.col("text")).alias(n) for n, b in names.items()])


_PROPERTIES = {"soft_dotted": "[ij]", "sentence_terminal": "[.!?]", "terminal_punctuation": "[!,.:;?]", "pattern_syntax": r"[!-/:-@\[-^`{-~]", "hyphen": "-", "other_math": r"\^", "deprecated": r"\x{E0001}"}


@query("chars_properties", "select p_partkey, " + ", ".join(f"cast(len(regexp_extract_all(p_name || p_type || '. a+b=c? x^2; i-j: ok!', '{p}')) as integer) as {n}" for n, p in _PROPERTIES.items()) + " from part")
def _(t):
    c = F.concat("p_name", "p_type", F.lit(". a+b=c? x^2; i-j: ok!"))
    return t.part.select("p_partkey", *[cc.binary_property(n).count(c).alias(n) for n in _PROPERTIES])


@query("text_scope_pipe", "select n_regionkey, count(*) as n from nation where n_nationkey > 3 group by 1")
def _(t):
    return t.nation.transform(lambda d: d.where("n_nationkey > 3")).groupBy("n_regionkey").agg(F.count("*").alias("n"))
