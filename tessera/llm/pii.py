"""Personal data: detection and keyed, type-consistent surrogates.

Detected entities are reduced to a type and a normal form (an e-mail address in
lower case, a number's digits), so that every mention of one is replaced alike,
in whatever format it stands.  A surrogate follows from a keyed hash of type and
normal form.  Surrogates are checked against each other and against all real
entities; of those that collide, all but one are drawn again, until none does.
Later draws are longer, so there is always room.  Family names are settled word
by word, then full names are put together from them.
Everything here is DataFrame code; texts without entities are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count as numbers_from

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import by_place, discard, materialise

# Forms of address and the gender that they tell.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "госпожа", "г-жа", "κυρία")
EITHER = ("Dr", "Prof", "доктор")
# Given names and syllables of family names by script.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl Daniel Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noah Oscar Paul Robert Simon Thomas Victor",
    ("latin", "f"): "Anna Bella Clara Diana Emma Fiona Greta Helen Irene Julia Karla Laura Maria Nora Olivia Paula Rosa Sofia Teresa Vera",
    ("cyrillic", "m"): "Алексей Борис Виктор Григорий Дмитрий Евгений Иван Кирилл Максим Николай Олег Павел",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Ксения Мария Нина Ольга Полина София",
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Κώστας Μάριος Νίκος Πέτρος Σπύρος",
    ("greek", "f"): "Άννα Βασιλική Ελένη Ζωή Ιωάννα Μαρία Σοφία Χριστίνα",
}
# Further given names that tell a gender.
MALE_NAMES = "James John Michael David William Richard Joseph Charles Peter Hans Klaus Jürgen Wolfgang Pierre Jean Jacques Michel José Juan Carlos Luis Miguel Antonio Javier"
FEMALE_NAMES = "Mary Linda Susan Elizabeth Karen Nancy Sarah Margaret Alice Ruth Ingrid Ursula Heike Marie Claire Sophie Camille Carmen Isabel Pilar Dolores"
SYLLABLES = {
    "latin": "bar bel cor dan del fen gar hal ker lan lor mar mel nor pel ran ros sel tan tor val ven wal zor",
    "cyrillic": "бар вел гор дан зор кар лен мар нов пет рад сав тим фед",
    "greek": "βαλ γαρ δελ καρ λαν μαρ νικ παλ ραν σελ ταρ φιλ",
}

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9][A-Za-z0-9-]{0,62}){1,8}"
_SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,48})(?![A-Za-z0-9])|(?<=(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Kk]ey|KEY) ?[=:] ?[\"'])[^\s\"']{6,128}(?=[\"'])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IP = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
_PHONE = (
    r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
    r"|(?<![0-9A-Za-z])\+(?=(?:[ .()-]*[0-9]){8,15}(?![0-9]))[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-][0-9]{2,8}){1,5}(?![0-9])"
    r"|(?<![0-9A-Za-z.+-])0[1-9](?:[ .-][0-9]{2}){4}(?![0-9.-])"
    r"|(?<![0-9A-Za-z])\+[0-9]{8,15}(?![0-9])"
)
_TITLES = "|".join(MALE + FEMALE + EITHER)
_NAME = rf"(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}\p{{Ll}}{{1,30}}(?: \p{{Lu}}\p{{Ll}}{{1,30}}){{0,2}}"

#: In this order: what an earlier form takes, a later one does not.
FORMS = (("email", _EMAIL), ("secret", _SECRET), ("ip", _IP), ("ssn", _SSN), ("card", _CARD), ("iban", _IBAN), ("phone", _PHONE), ("name", _NAME))
PATTERN = "|".join(f"(?:{p})" for _, p in FORMS)
#: What a text must hold to be searched at all.
_HINT = rf"[0-9@]|(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}|[=:] ?[\"']|AKIA|sk-|gh[pousr]_|[a-f]{{32}}|[A-F]{{32}}"

#: From this draw on, a surrogate is longer than the original by two digits more a draw.
_LONGER = 4
#: From this draw on, a made-up name has a syllable more a draw; given names are made up from _LONGER on.
_SYLLABLES_MORE = 2


def _kind(raw: Column) -> Column:
    """The type of a detected entity."""
    tests = (
        ("email", raw.contains("@") & raw.rlike(f"^(?:{_EMAIL})$")),
        ("ip", raw.rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$")),
        ("ssn", raw.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        ("card", raw.rlike(r"^[0-9](?:[ -]?[0-9]){12,18}$")),
        ("phone", raw.rlike(r"^[+(0-9][0-9() .-]*$") & raw.rlike(r"^(?:[^0-9]*[0-9]){8}")),
        ("name", raw.rlike(rf"^(?:{_TITLES})\.? ")),
        ("iban", raw.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$") & ~raw.rlike("^AKIA")),
    )
    return reduce(lambda rest, t: F.when(t[1], F.lit(t[0])).otherwise(rest), reversed(tests), F.lit("secret"))


def _normal(kind: Column, raw: Column) -> Column:
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return F.when(kind == "email", F.lower(raw)).when(kind.isin("ssn", "card", "phone"), digits).when(kind == "iban", F.regexp_replace(raw, " ", "")).otherwise(raw)


def _hashes(key: str, kind: Column, normal: Column, draw: Column) -> Column:
    """512 hexadecimal digits from the key, the entity and the draw: two for each character of the longest form."""
    base = F.concat_ws("\u0001", F.lit(key), kind, draw.cast("string"), normal)
    return F.concat(*[F.sha2(F.concat(base, F.lit(f"\u0001{i}")).cast("binary"), 512) for i in range(4)])


def _number(h: Column, at: Column | int, digits: int = 2) -> Column:
    """The at-th (from 0) number of so many hexadecimal digits."""
    start = (at if isinstance(at, Column) else F.lit(at)) * digits + 1
    return F.conv(F.substring(h, start.cast("int"), F.lit(digits)), 16, 10).cast("int")


def _same_format(text: Column, h: Column) -> Column:
    """Digits for digits and letters for letters of either case, of any script; all else stays, but becomes
    letters where there is nothing else.  Hexadecimal stays hexadecimal."""
    lower, upper = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    hexa = text.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & (F.length(text) >= 32)
    low = text.rlike("[a-f]")
    marks = ~text.rlike(r"[\p{L}\p{M}\p{N}]")

    def one(c: Column, i: Column) -> Column:
        n = _number(h, i % 240)
        h16 = F.hex((n % 16).cast("long"))
        return (
            F.when(hexa, F.when(low, F.lower(h16)).otherwise(h16))
            .when(c.rlike(r"^\p{N}$"), (n % 10).cast("string"))
            .when(c.rlike(r"^\p{Lu}$"), F.substring(upper, n % 26 + 1, F.lit(1)))
            .when(marks | c.rlike(r"^[\p{L}\p{M}]$"), F.substring(lower, n % 26 + 1, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn checksum of a string of digits: every second from the right doubled."""

    def term(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), term), F.lit(0), lambda a, b: a + b)


def _card(digits: Column, h: Column) -> Column:
    """So many digits, the first kept; with a right check digit if the original's is right."""
    body = F.concat(F.substring(digits, F.lit(1), F.lit(1)), _same_format(F.substring(digits, F.lit(2), F.length(digits) - 2), h))
    check = (10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return F.when(_luhn_sum(digits) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(F.concat(body, (_number(h, 200) % 10).cast("string")))


def _pool(words: str, n: Column) -> Column:
    own = words.split()
    return F.element_at(F.array(*[F.lit(w) for w in own]), (n % len(own) + 1).cast("int"))


def _words(raw: Column) -> tuple[Column, Column]:
    """A name's title, with what stands between, and its words."""
    title = F.regexp_extract(raw, rf"^(?:{_TITLES})\.? ", 0)
    return title, F.split(F.substring(raw, F.length(title) + 1, F.length(raw)), " ")


def _word_hash(word: Column, key: str, draw: int) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit("name"), F.lit(str(draw)), word).cast("binary"), 256)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _family(word: Column, key: str, draw: int) -> Column:
    """Three syllables of the word's script, more in later draws."""
    h, script = _word_hash(word, key, draw), _script(word)
    size = min(15, 3 + max(0, draw - _SYLLABLES_MORE + 1))  # a hash has 15 numbers besides the given name's
    parts = [reduce(lambda rest, s, k=k: F.when(script == s[0], _pool(s[1], _number(h, k, 4))).otherwise(rest), SYLLABLES.items(), F.lit("")) for k in range(1, size + 1)]
    return F.initcap(F.concat(*parts))


def _given(title: Column, word: Column, key: str, draw: int) -> Column:
    """A given name by gender and script; once those are too few, a made-up one."""
    if draw >= _LONGER:
        return _family(word, key, draw)
    h, script = _word_hash(word, key, draw), _script(word)
    bare = F.regexp_replace(title, r"\.? $", "")
    known = {sex: " ".join([more, *(names for (_, s), names in GIVEN.items() if s == sex)]).split() for sex, more in (("m", MALE_NAMES), ("f", FEMALE_NAMES))}
    # By the title, else the name itself, else its ending; what tells nothing gets either.
    sex = F.when(bare.isin(*MALE), "m").when(bare.isin(*FEMALE), "f").when(word.isin(*known["m"]), "m").when(word.isin(*known["f"]), "f")
    sex = sex.when(word.rlike("[aàáаяαάηή]$"), "f").when(word.rlike("[oоςйό]$"), "m").otherwise(F.when(_number(h, 9, 4) % 2 == 0, "m").otherwise("f"))
    return reduce(lambda rest, g: F.when((script == g[0][0]) & (sex == g[0][1]), _pool(g[1], _number(h, 0, 4))).otherwise(rest), GIVEN.items(), F.lit(""))


def _surrogate(key: str, kind: Column, normal: Column, draw: int) -> Column:
    h = _hashes(key, kind, normal, F.lit(draw))
    local = F.substring_index(normal, "@", 1)
    # where a format is too narrow for all
    more = F.concat(F.lit("."), F.substring(h, F.lit(401), F.lit(8))) if draw > 3 else F.lit("")
    longer = F.translate(F.substring(h, F.lit(409), F.lit(2 * max(0, draw - _LONGER + 1))), "abcdef", "012345")
    email = F.concat(_same_format(local, h), more, longer, F.lit("@example."), _pool("com net org", _number(h, 120)))
    octets = F.concat_ws(".", *[(_number(h, i, 4) % 254 + 1).cast("string") for i in range(4)], *([longer] if draw >= _LONGER else []))
    phone = F.concat(F.substring(normal, F.lit(1), F.lit(1)), _same_format(F.substring(normal, F.lit(2), F.length(normal)), h))
    iban = F.concat(F.substring(normal, F.lit(1), F.lit(2)), _same_format(F.substring(normal, F.lit(3), F.length(normal)), h))
    same = F.when(kind == "card", _card(normal, h)).when(kind == "phone", phone).when(kind == "iban", iban).otherwise(_same_format(normal, h))
    return F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "family", _family(normal, key, draw)).otherwise(F.concat(same, longer))


def _rendered(kind: Column, raw: Column, core: Column) -> Column:
    """The surrogate in the mention's own format: its digits put where the mention has digits."""
    places = F.filter(F.sequence(F.lit(1), F.length(raw)), lambda i: F.substring(raw, i, F.lit(1)).rlike("^[A-Za-z0-9]$"))
    put = F.array_join(
        F.transform(F.split(raw, ""), lambda c, i: F.when(c.rlike("^[A-Za-z0-9]$"), F.substring(core, F.array_position(places, i + 1).cast("int"), F.lit(1))).otherwise(c)), ""
    )
    rest = F.substring(core, F.size(places) + 1, F.length(core))  # of a surrogate longer than the mention
    return F.when(kind.isin("ssn", "card", "phone", "iban"), F.concat(put, rest)).otherwise(core)


def _settle(real: DataFrame, core: Callable[[int], Column]) -> DataFrame:
    """``real`` (kind, normal, ...) with a core for each: no two of a kind alike, none equal to a real one."""
    pending, settled = real, None
    for draw in numbers_from():
        drawn = materialise(pending.withColumn("core", core(draw)))
        first = drawn.groupBy("kind", "core").agg(F.min("normal").alias("first"))
        taken = real.select(F.col("kind").alias("k"), F.col("normal").alias("c"))
        if settled is not None:
            taken = taken.union(settled.select("kind", "core"))
        free = first.join(taken, (F.col("kind") == F.col("k")) & (F.col("core") == F.col("c")), "left_anti").select(F.col("kind").alias("k"), F.col("first").alias("f"))
        won = materialise(drawn.join(free, (F.col("kind") == F.col("k")) & (F.col("normal") == F.col("f")), "left_semi"))
        lost = materialise(drawn.join(free, (F.col("kind") == F.col("k")) & (F.col("normal") == F.col("f")), "left_anti").drop("core"))
        discard(drawn)
        settled = won if settled is None else settled.unionAll(won)
        if not lost.take(1):
            return settled
        pending = lost


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, normal, core for distinct entities (kind, normal): no two of a kind alike, none equal to a real one.

    A word of a family name has one surrogate wherever it stands, so "Mr Adam
    Bell" and "Mr Bell" stay the same person's.  None is a real family name, so
    no full name is a real one.
    """
    every = materialise(entities.select("kind", "normal").distinct())
    title, words = _words(F.col("normal"))
    names = every.where("kind = 'name'").select("kind", "normal", title.alias("title"), F.when(F.size(words) > 1, words[0]).alias("given"), F.when(F.size(words) > 1, F.slice(words, 2, 2)).otherwise(words).alias("families"))
    family = names.select(F.lit("family").alias("kind"), F.explode("families").alias("normal")).distinct()
    parts = _settle(materialise(every.where("kind <> 'name'").unionAll(family)), lambda draw: _surrogate(key, F.col("kind"), F.col("normal"), draw))
    own = parts.where("kind = 'family'").select(F.col("normal").alias("word"), "core")
    placed = names.select("kind", "normal", "title", "given", F.posexplode("families").alias("pos", "word")).join(own, "word")
    called = placed.groupBy("kind", "normal", "title", "given").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "core"))), lambda f: f["core"]), " ").alias("families"))
    full = _settle(materialise(called), lambda draw: F.concat(F.col("title"), F.when(F.col("given").isNull(), "").otherwise(F.concat(_given(F.col("title"), F.col("given"), key, draw), F.lit(" "))), F.col("families")))
    return parts.where("kind <> 'family'").unionAll(full.select("kind", "normal", "core"))


def tagged(docs: DataFrame) -> DataFrame:
    """``docs`` by place (`by_place`) with _row and _e: the entities in the order of the text; null or empty where there are none.

    Every text is searched here, once; the frame is written, so what follows reads the marks.
    """
    placed, at, _ = by_place(docs)
    found = F.when(at("text").rlike(_HINT), F.regexp_extract_all(at("text"), F.lit(PATTERN), F.lit(0)))
    return materialise(placed.withColumn("_e", found).withColumn("_row", F.monotonically_increasing_id()))


def occurrences(marked: DataFrame) -> DataFrame:
    """_row, pos, raw, kind, normal of every entity in `tagged` texts."""
    each = marked.where(F.size("_e") > 0).select("_row", F.posexplode("_e").alias("pos", "raw")).withColumn("kind", _kind(F.col("raw")))
    return each.withColumn("normal", _normal(F.col("kind"), F.col("raw")))


def pseudonymise(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """``docs`` with every detected entity replaced in ``text`` (and n_chars, if there, following it).

    Keeps all columns, whatever their names, and adds one named ``count`` with
    the number of entities if asked for.  Null and empty texts stay as they are;
    repeated rows are replaced alike; an empty table stays empty.  Texts are
    searched once and as a whole; only those with entities are shuffled.
    """
    marked = tagged(docs)
    _, at, back = by_place(docs)
    text = at("text")
    found = materialise(occurrences(marked))
    table = surrogates(found, key).select(F.col("kind").alias("k"), F.col("normal").alias("n"), "core")
    placed = found.join(table, (F.col("kind") == F.col("k")) & (F.col("normal") == F.col("n"))).withColumn("out", _rendered(F.col("kind"), F.col("raw"), F.col("core")))
    whole = placed.groupBy(F.col("_row").alias("_d")).agg(F.sort_array(F.collect_list(F.struct("pos", "out"))).alias("_r"))
    has = F.coalesce(F.size("_e"), F.lit(0)) > 0
    met = marked.where(has).join(whole, F.col("_row") == F.col("_d"))
    between = F.split(text, PATTERN, -1)
    done = met.withColumn("_t", F.array_join(F.transform(between, lambda s, i: F.concat(s, F.coalesce(F.get(F.col("_r"), i)["out"], F.lit("")))), ""))
    new = list(back)
    new[docs.columns.index("text")] = F.col("_t").alias("text")
    if "n_chars" in docs.columns:
        new[docs.columns.index("n_chars")] = F.length("_t").cast(dict(docs.dtypes)["n_chars"]).alias("n_chars")
    extra = ([F.size("_r").cast("long").alias(count)], [F.lit(0).cast("long").alias(count)]) if count else ([], [])
    return done.select(*new, *extra[0]).unionAll(marked.where(~has).select(*back, *extra[1]))
