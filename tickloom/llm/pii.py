"""Surrogates for personal data (operator 3), in DataFrame and SQL functions only.

Entities are found by one pattern. Each has a canonical form that doesn't depend on how it is written (digits of a phone
or card number, lower-case addresses, a bank account without blanks), a keyed surrogate is made of that, and it is put
back into the format of the entity: so equal entities get equal surrogates however they are written (coreference), and
letters keep script and case. Numbers, accounts and addresses move by Feistel networks over their own characters, with
right check digits where the original has them; names, whose gender comes from the title or else the given name, become
given names of that gender and family names of like length made of syllables of their script, part by part, so that a
family keeps one name. All of it is keyed by SHA-256 of a secret key (`spark.tickloom.pii.key`, or the parameter).

The collision check is over the distinct canonical forms of the whole table: a surrogate that two of a kind share, that
is the entity itself, or that another entity of the table has as its own, is made again under a further key for all but
the first (by text) that it suits; what is still not distinct after TRIES gets a number at its end.

Defined results: a null text stays null and has no entities. An empty table gives no rows; rows that repeat get the same
result each. Other columns are not looked at and may have any names. Spans are offsets in the original, without titles and
words before an entity, which stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Workspace, keyed, small

#: The key where the session names none: for tests and trials only, as anyone can read it here.
KEY, SETTING = "tickloom", "spark.tickloom.pii.key"
ROUNDS, TRIES = 4, 12
# The patterns of each type, in order of precedence; and what stands before an entity and stays.
MALE, FEMALE, EITHER = "Mr|Herr|Sr|Señor|Monsieur", "Mrs|Ms|Miss|Frau|Mme|Madame|Sra|Señora", "Dr|Prof"
BEFORE = {
    "name": rf"\b(?:{MALE}|{FEMALE}|{EITHER})\.? ",
    "birth": r"\b(?:[Bb]orn(?: on)?|DOB|[Dd]ate of birth|[Gg]eboren am|geb\.|[Nn]ée? le|[Nn]acid[oa] el):? ",
    "passport": r"\b(?:[Pp]assport|[Rr]eisepass|[Pp]asaporte|[Pp]asseport)(?: [Nn]o\.?| [Nn]umber| Nr\.?| n°)?:? ",
    "postal": r"\b(?:ZIP|PLZ|[Pp]ostal code|[Pp]ostcode|[Cc]ode postal|[Cc]ódigo postal):? ",
}
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "token": r"(?<![0-9A-Za-z_])(?:(?:sk|pk|rk)_(?:live|test)_[0-9A-Za-z]{8,}|gh[pousr]_[0-9A-Za-z]{20,}|AKIA[0-9A-Z]{16}|xox[abp]-[0-9A-Za-z-]{10,})(?![0-9A-Za-z])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "card": r"(?<!\d)\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{3,4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)\d{2,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "birth": BEFORE["birth"] + r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}(?!\d)",
    "passport": BEFORE["passport"] + r"[A-Z]{1,2}\d{6,8}(?!\w)",
    "postal": BEFORE["postal"] + r"\d{4,5}(?:-\d{4})?(?!\w)",
    "street": r"(?<![\w.])\d{1,5} (?:\p{Lu}\p{Ll}+ ){1,2}(?:Street|St\.|Avenue|Ave\.|Road|Rd\.|Lane|Boulevard|Blvd\.)(?!\w)|(?<!\w)\p{Lu}\p{Ll}+(?:straße|strasse|gasse|allee) \d{1,4}(?!\w)",
    "name": BEFORE["name"] + r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?(?: \p{Lu}\p{Ll}+)?",
}
# Given names by gender and script, and the parts of family names by script.
NAMES = {
    ("f", "latin"): "Anna Clara Diane Elena Fiona Grace Helen Irene Julia Laura Maria Nora Olivia Paula Rosa Sofia Tessa Vera Wanda Yvonne".split(),
    ("m", "latin"): "Adam Bruno Carl David Erik Felix Georg Hugo Ivan Jonas Karl Lukas Martin Oscar Paul Simon Thomas Victor Walter Xaver".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Мария Ольга".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Иван Павел Сергей".split(),
}
SYLLABLES = {
    "latin": ("b br d dr f g gr h j k kl l m n p r s st t tr v w z".split(), "a e i o u ei au".split(), "ler man sen ner berg hoff ten rin dal son lund feld mar vic rell ton".split()),
    "cyrillic": ("б в г д ж к л м н п р с т х".split(), "а е и о у".split(), "нов лин ский дев рин мов тин лев".split()),
}
CLASSES = (("a", 26), ("A", 26), ("0", 10), ("а", 32), ("А", 32), ("α", 25), ("Α", 25))
TITLE = f"^(?:{MALE})\\.? "


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is computed once however often f names it."""
    return F.transform(F.array(value), f)[0]


def _keyed(salt: Column, *told: Column) -> Column:
    """64 hexadecimal digits that depend on the key and all that is told."""
    return F.sha2(F.concat_ws("\0", salt, *told), 256)


def _number(salt: Column, *told: Column) -> Column:
    """A keyed number of 60 bits."""
    return F.conv(F.substring(_keyed(salt, *told), 1, 15), 16, 10).cast("long")


def _class(c: Column) -> Column:
    """(first code point, size) of the alphabet of a character; size 0 keeps it."""
    code = F.ascii(c)
    out = F.struct(F.lit(0).alias("base"), F.lit(0).alias("size"))
    for first, size in CLASSES:
        base = ord(first)
        out = F.when((code >= base) & (code < base + size), F.struct(F.lit(base).alias("base"), F.lit(size).alias("size"))).otherwise(out)
    return out


def _chars(s: Column) -> Column:
    return F.split(s, "")


def _moved(part: Column, other: Column, salt: Column) -> Column:
    """Characters of part, each moved within its alphabet by an amount that depends on the key, all of other and its place."""

    def all_of(told: Column) -> Column:
        def move(c: Column, i: Column) -> Column:
            at = 1 + (i * 2) % 62
            shift = F.ascii(F.substring(told, at, F.lit(1))) * 37 + F.ascii(F.substring(told, at + 1, F.lit(1)))
            return _once(_class(c), lambda k: F.when(k["size"] > 0, F.chr(k["base"] + (F.ascii(c) - k["base"] + shift) % k["size"])).otherwise(c))

        return F.transform(part, move)

    return _once(_keyed(salt, F.concat_ws("", other)), all_of)


def _halves(s: Column, salt: Column) -> Column:
    """Feistel over the characters of s: each round moves one half by the other; classes of characters, and so the format, stay."""

    def split(chars: Column) -> Column:
        cut = F.ceil(F.size(chars) / 2).cast("int")
        start = F.struct(F.slice(chars, F.lit(1), cut).alias("a"), F.slice(chars, cut + 1, F.size(chars)).alias("b"))
        step = lambda x, r: F.struct(x["b"].alias("a"), _moved(x["a"], x["b"], F.concat(salt, r.cast("string"))).alias("b"))
        return _once(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step), lambda end: F.concat(F.array_join(end["a"], ""), F.array_join(end["b"], "")))

    return _once(_chars(s), split)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _into(s: Column, chars: Column, kept: str = "[^0-9]") -> Column:
    """s with its characters, but those kept, replaced one by one by those of the other string; capitals stay capitals."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(x: Column, c: Column) -> Column:
        stays = c.rlike(f"^{kept}$")
        new = F.substring(chars, x["at"], F.lit(1))
        return F.struct(F.concat(x["out"], F.when(stays, c).when(c.rlike(r"^\p{Lu}$"), F.upper(new)).otherwise(new)).alias("out"), (x["at"] + (~stays).cast("int")).alias("at"))

    return F.aggregate(_chars(s), start, put)["out"]


def _luhn(digits: Column) -> Column:
    """Sum over the digits before the check digit."""
    chars = F.reverse(_chars(digits))
    weighted = F.transform(chars, lambda c, i: (c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1)))
    return F.aggregate(weighted, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0))


def _card(old: Column, after: Column) -> Column:
    """after: what all digits but the last become. All digits but the last move; the last keeps its distance from the right check digit, so valid numbers stay valid."""
    before = F.substring(old, F.lit(1), F.length(old) - 1)
    return F.concat(after, F.pmod(F.substring(old, F.length(old), F.lit(1)).cast("int") + _luhn(before) - _luhn(after), F.lit(10)).cast("string"))


def _check97(country: Column, rest: Column) -> Column:
    """The right check digits of a bank account, 2 to 98."""
    chars = _chars(F.concat(rest, country, F.lit("00")))
    return 98 - F.aggregate(chars, F.lit(0), lambda m, c: F.when(c.between("0", "9"), (m * 10 + F.ascii(c) - 48) % 97).otherwise((m * 100 + F.ascii(c) - 55) % 97))


def _iban(old: Column, after: Column) -> Column:
    """after: what the account becomes. The account moves; the check digits keep their distance from the right ones, so valid accounts stay valid."""
    country, check, rest = F.substring(old, 1, 2), F.substring(old, 3, 2).cast("int"), F.substring(old, F.lit(5), F.length(old))

    off = F.pmod(check - _check97(country, rest) + _check97(country, after) - 2, F.lit(97)) + 2
    # 0, 1 and 99 are never right: they stay, so that different accounts stay different
    return F.concat(country, F.lpad(F.when(check.between(2, 98), off).otherwise(check).cast("string"), 2, "0"), after)


def _ip(s: Column, salt: Column) -> Column:
    """Feistel over the two halves of the 32-bit number. An octet with a leading zero, which has two digits, moves among the ten of that form."""

    def octet(x: Column) -> Column:
        led = (F.length(x) > 1) & x.startswith("0")
        return F.struct(x.cast("long").alias("v"), F.when(led, 10).otherwise(256).cast("long").alias("size"))

    def moved(o: Column) -> Column:
        half = lambda i: [o[i]["v"] * o[i + 1]["size"] + o[i + 1]["v"], o[i]["size"] * o[i + 1]["size"]]
        (a, m), (b, n) = half(0), half(2)
        start = F.struct(a.alias("a"), b.alias("b"), m.alias("m"), n.alias("n"))
        # the halves change places in each round, and their sizes with them
        step = lambda x, r: F.struct(x["b"].alias("a"), F.pmod(x["a"] + _number(salt, r.cast("string"), x["b"].cast("string")), x["m"]).cast("long").alias("b"), x["n"].alias("m"), x["m"].alias("n"))
        put = lambda v, size: F.concat(F.when(size == 10, "0").otherwise(""), v.cast("string"))
        whole = lambda v, i: F.concat(put(F.floor(v / o[i + 1]["size"]).cast("long"), o[i]["size"]), F.lit("."), put(v % o[i + 1]["size"], o[i + 1]["size"]))
        return _once(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step), lambda end: F.concat(whole(end["a"], 0), F.lit("."), whole(end["b"], 2)))

    return _once(F.transform(F.split(s, r"\."), octet), moved)


def _hex(s: Column, salt: Column) -> Column:
    """Feistel over the two halves of the digits, in the case of the original: each round adds keyed digits to one half."""
    digits = "0123456789abcdef"
    value = lambda c: F.instr(F.lit(digits), c) - 1
    low = F.lower(s)
    cut = F.floor(F.length(low) / 2).cast("int")
    start = F.struct(F.substring(low, F.lit(1), cut).alias("a"), F.substring(low, cut + 1, F.length(low)).alias("b"))

    def step(x: Column, r: Column) -> Column:
        add = lambda told: F.array_join(F.transform(_chars(x["a"]), lambda c, i: F.substring(F.lit(digits), (value(c) + value(F.substring(told, i % 64 + 1, F.lit(1)))) % 16 + 1, F.lit(1))), "")
        return F.struct(x["b"].alias("a"), _once(_keyed(F.concat(salt, r.cast("string")), x["b"]), add).alias("b"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return _once(out, lambda end: F.when(s == F.upper(s), F.upper(F.concat(end["a"], end["b"]))).otherwise(F.concat(end["a"], end["b"])))


def _picked(rows: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in rows]), (F.pmod(at, F.lit(len(rows))) + 1).cast("int"))


def _script(part: Column) -> Column:
    return F.when(part.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(part.rlike(r"^\p{IsLatin}"), "latin")


def _syllables(script: str, n: Column) -> Callable[[Column], Column]:
    """A number to a name of n syllables and an ending."""
    onsets, vowels, ends = SYLLABLES[script]
    base = len(onsets) * len(vowels)
    syllable = lambda v: F.concat(_picked(onsets, v % len(onsets)), _picked(vowels, F.floor(v / len(onsets))))
    at = lambda h, k: F.pmod(F.floor(h / F.pow(F.lit(base), k - 1)).cast("long"), F.lit(base))
    return lambda h: F.initcap(F.concat(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: _once(at(h, k), syllable)), ""), _picked(ends, F.shiftrightunsigned(h, 52))))


def _family(part: Column, salt: Column) -> Column:
    """A family name of like length, made of syllables; other scripts than those listed move letter by letter."""
    n = F.greatest(F.lit(1), F.least(F.lit(5), F.floor((F.length(part) - 2) / 2))).cast("int")
    out = _halves(part, salt)
    for script in SYLLABLES:
        out = F.when(_script(part) == script, _once(_number(salt, F.lower(part)), _syllables(script, n))).otherwise(out)
    return out


def _name(s: Column, salt: Column, male: Column, female: Column) -> Column:
    """Given name and family name, or a family name alone; s has no title."""
    parts = F.split(s, " ")

    def given(part: Column) -> Column:
        out = _family(part, salt)
        for (gender, script), rows in NAMES.items():
            listed = F.array_contains(F.array(*[F.lit(x) for x in rows]), part)
            other = F.array_contains(F.array(*[F.lit(x) for x in NAMES["m" if gender == "f" else "f", script]]), part)
            titled = male if gender == "m" else female
            neither = ~male & ~female & ~listed & ~other & (F.pmod(_number(salt, F.lit("gender"), part), F.lit(2)) == int(gender == "f"))
            place = _number(salt, F.lit("given"), part)
            at = F.array_position(F.array(*[F.lit(x) for x in rows]), part) - 1  # a listed name never stays
            moved = F.when(at >= 0, at + 1 + F.pmod(place, F.lit(len(rows) - 1))).otherwise(place)
            out = F.when((_script(part) == script) & (titled | (~male & ~female & listed) | neither), _picked(rows, moved)).otherwise(out)
        return out

    two = F.size(parts) > 1
    return F.concat(F.when(two, F.concat(given(parts[0]), F.lit(" "))).otherwise(""), _family(F.when(two, F.get(parts, F.lit(1))).otherwise(s), salt))


def _birth(s: Column, salt: Column) -> Column:
    """Another date in the same format: the year moves by up to 9, day and month among the first 28 and 12."""
    moved = lambda part, i: F.when(F.length(part) == 4, (part.cast("int") - 9 + F.pmod(_number(salt, F.lit("y"), s), F.lit(19))).cast("string")).otherwise(F.lpad((1 + F.pmod(part.cast("int") - 1 + _number(salt, i.cast("string"), s), F.lit(12))).cast("string"), F.length(part), "0"))
    return _into(s, F.array_join(F.transform(F.split(s, "[./-]"), moved), ""))


def _street(s: Column, salt: Column, after: Column) -> Column:
    """after: what the house number behind its first digit becomes. House number and words move, the kind of street stays."""
    word = F.regexp_extract(s, r"(\p{Lu}\p{Ll}+?)(?:straße|strasse|gasse|allee|(?: \p{Lu}\p{Ll}+)? (?:Street|St\.|Avenue|Ave\.|Road|Rd\.|Lane|Boulevard|Blvd\.))", 1)
    named = F.replace(s, word, _family(word, salt))
    digits = _digits(s)
    return _into(named, F.concat(F.pmod(F.substring(digits, 1, 1).cast("int") - 1 + _number(salt, F.lit("n"), s), F.lit(9)) + 1, after))


def kind_of(entity: Column) -> Column:
    """The first type whose pattern matches the whole entity; its neighbours in the text no longer count, so names come last."""
    out = F.lit("name")
    for name, pattern in reversed([x for x in PATTERNS.items() if x[0] != "name"]):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def before(entity: Column, kind: Column) -> Column:
    """The title or words at the start of an entity, which stay."""
    out = F.lit("")
    for name, pattern in BEFORE.items():
        out = F.when(kind == name, F.regexp_extract(entity, f"^(?:{pattern})", 0)).otherwise(out)
    return out


def canonical(entity: Column, kind: Column) -> Column:
    """What is equal in all ways to write an entity; a name has its gender in front."""
    core = F.substring(entity, F.length(before(entity, kind)) + 1, F.length(entity))
    listed = lambda g: F.array_contains(F.array(*[F.lit(x) for (of, _), rows in NAMES.items() if of == g for x in rows]), F.substring_index(core, " ", 1))
    gender = F.when(entity.rlike(TITLE), "m").when(entity.rlike(f"^(?:{FEMALE})\\.? "), "f").when(listed("m"), "m").when(listed("f"), "f").otherwise("")
    return (
        F.when(kind == "email", F.lower(entity)).when(kind.isin("phone", "card", "ssn"), _digits(entity)).when(kind == "iban", F.replace(entity, F.lit(" "), F.lit(""))).when(kind == "name", F.concat(gender, F.lit("|"), core)).otherwise(core)
    )


def made_of(told: Column, kind: Column, key: str = KEY) -> Column:
    """The surrogate of a canonical form, in canonical form."""
    salt = F.concat(F.lit(key + "\0"), kind)
    local, domain = F.substring_index(told, "@", 1), F.substring_index(told, "@", -1)
    site = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1)
    token = F.regexp_extract(told, r"^(?:[a-z]{2}_(?:live|test)_|gh[a-z]_|AKIA|xox[a-z]-)", 0)
    country = F.regexp_extract(told, r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", 0)
    plain, by = F.substring_index(told, "|", -1), F.substring_index(told, "|", 1)
    start = F.when(kind == "token", token).when((kind == "phone") & (F.length(told) > 10), country).otherwise("")
    behind = lambda s, n: F.substring(s, n + 1, F.length(s))
    # What moves by halves, whatever the kind: named once, as the expression is large, and each plan holds it as often as it is named.
    part = lambda s, at=salt: F.struct(s.alias("part"), at.alias("salt"))
    parts = (
        F.when(kind == "email", F.array(part(local), part(site, F.concat(salt, F.lit("@")))))
        .when(kind.isin("ip", "secret", "name", "birth"), F.array().cast("array<struct<part:string,salt:string>>"))
        .when(kind == "card", F.array(part(F.substring(told, F.lit(1), F.length(told) - 1))))
        .when(kind == "iban", F.array(part(behind(told, F.lit(4)))))
        .when(kind == "street", F.array(part(behind(_digits(told), F.lit(1)))))
        .otherwise(F.array(part(behind(told, F.length(start)))))
    )

    def put(moved: Column) -> Column:
        first = F.get(moved, F.lit(0))
        return (
            F.when(kind == "email", F.concat(first, F.lit("@"), F.get(moved, F.lit(1)), behind(domain, F.length(site))))
            .when(kind == "ip", _ip(told, salt))
            .when(kind == "card", _card(told, first))
            .when(kind == "secret", _hex(told, salt))
            .when(kind == "iban", _iban(told, first))
            .when(kind == "name", _name(plain, salt, by == "m", by == "f"))
            .when(kind == "birth", _birth(told, salt))
            .when(kind == "street", _street(told, salt, first))
            .otherwise(F.concat(start, first))
        )

    return _once(F.transform(parts, lambda x: _halves(x["part"], x["salt"])), put)


def written(entity: Column, kind: Column, new: Column) -> Column:
    """A canonical surrogate in the format of the entity, without the words before it."""
    return F.when(kind.isin("phone", "card", "ssn"), _into(entity, new)).when(kind == "iban", _into(entity, new, " ")).when(kind == "email", _into(entity, new, "(?!.)")).otherwise(new)


def surrogate(entity: Column, kind: Column, key: str = KEY) -> Column:
    """The first surrogate of an entity, in its format."""
    return written(entity, kind, made_of(canonical(entity, kind), kind, key))


def pattern() -> str:
    return "|".join(f"(?:{p})" for p in PATTERNS.values())


def _settled(each: DataFrame, key: str, work: Workspace) -> DataFrame:
    """(kind, told, new) of the entities whose first surrogate won't do: all surrogates of a kind are then distinct and nobody's own."""
    rows = each.withColumn("turn", F.lit(0))
    for k in range(1, TRIES + 1):
        first = rows.groupBy("kind", "new").agg(F.min(F.struct("turn", "told")).alias("first"), F.count("*").alias("n")).where("n > 1").select("kind", "new", F.col("first.told").alias("told"))
        shared = rows.join(first.select("kind", "new"), ["kind", "new"], "left_semi").join(first, ["kind", "new", "told"], "left_anti").select("kind", "told")
        own = rows.join(rows.select("kind", F.substring_index("told", "|", -1).alias("new")), ["kind", "new"], "left_semi").select("kind", "told")
        odd = work.write(shared.union(own).distinct(), f"odd{k}")
        if not odd.limit(1).count():
            break
        last = F.concat(F.lit("#"), F.xxhash64("told").cast("string")) if k == TRIES else F.lit("")
        moved = odd.select("kind", "told", F.concat(made_of(F.col("told"), F.col("kind"), f"{key}\0{k}"), last).alias("new"), F.lit(k).alias("turn"))
        rows = work.write(rows.join(odd, ["kind", "told"], "left_anti").unionByName(moved), f"settled{k}")
    return rows.where("turn > 0").select("kind", "told", "new")


def surrogates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key: str | None = None, work: Workspace | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text with surrogates, n_entities, n_unchanged (always 0), entities (type, start in the original, length, surrogate)."""
    spark = docs.sparkSession
    key = key or spark.conf.get(SETTING, KEY)
    work = work or Workspace(spark, "pii")
    may = F.col("text").rlike(rf"[0-9@]|\b(?:{MALE}|{FEMALE}|{EITHER})\.? \p{{Lu}}")  # others are not searched further
    found = keyed(work, docs).select("kf", "kr", F.col("row")[id_col].alias("doc_id"), F.col("row")[text_col].alias("text"))
    found = found.withColumn("found", F.when(may, F.regexp_extract_all(F.col("text"), F.lit(pattern()), F.lit(0))))
    # Every distinct entity once: its surrogate is made here, checked for collisions, and made again the same way below.
    # They are dealt out anew, as few bytes hold much work and would be put together in few tasks.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = found.select(F.explode("found").alias("entity")).distinct().select(kind_of(F.col("entity")).alias("kind"), "entity")
    each = each.select("kind", canonical(F.col("entity"), F.col("kind")).alias("told")).distinct().repartition(parts)
    each = work.write(each.withColumn("new", made_of(F.col("told"), F.col("kind"), key)), "entities")
    again = _settled(each, key, work)
    pair = lambda kind, told: F.concat_ws("\0", kind, told)
    if again.limit(1).count():
        listed = F.map_from_entries(F.collect_list(F.struct(pair("kind", "told"), "new"))).alias("again")
        if small(again):
            found = found.join(F.broadcast(again.agg(listed)))
        else:  # each row gets those of its own entities
            e = found.select("kf", "kr", F.explode(F.array_distinct("found")).alias("e")).select("kf", "kr", kind_of(F.col("e")).alias("kind"), "e")
            mine = e.select("kf", "kr", "kind", canonical(F.col("e"), F.col("kind")).alias("told")).distinct().join(again, ["kind", "told"])
            found = found.join(work.write(mine.groupBy("kf", "kr").agg(listed), "again").hint("shuffle_hash"), ["kf", "kr"], "left")
        new = lambda kind, told: F.coalesce(F.try_element_at("again", pair(kind, told)), made_of(told, kind, key))
    else:
        new = lambda kind, told: made_of(told, kind, key)
    made = F.transform("found", lambda e: F.struct(kind_of(e).alias("type"), e.alias("e")))
    made = F.transform(made, lambda x: F.struct(x["type"].alias("type"), x["e"].alias("e"), before(x["e"], x["type"]).alias("lead"), canonical(x["e"], x["type"]).alias("told")))
    made = F.transform(made, lambda x: F.struct(x["type"].alias("type"), F.length(x["lead"]).alias("skip"), F.length(x["e"]).alias("length"), x["lead"].alias("lead"), written(x["e"], x["type"], new(x["type"], x["told"])).alias("surrogate")))
    some = F.size("found") > 0
    rows = found.withColumn("made", F.when(some, made)).withColumn("pieces", F.when(some, F.split("text", pattern(), -1)))
    text = F.when(F.col("made").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.zip_with("made", F.expr("slice(pieces, 1, size(made))"), lambda m, p: F.concat(p, m["lead"], m["surrogate"])), ""), F.element_at("pieces", -1)))
    starts = F.aggregate(
        F.sequence(F.lit(1), F.size("made")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda a, i: F.struct((a["at"] + F.length(F.element_at("pieces", i)) + F.element_at("made", i)["length"]).alias("at"), F.concat(a["all"], F.array(a["at"] + F.length(F.element_at("pieces", i)))).alias("all")),
    )["all"]
    entities = F.zip_with("made", "starts", lambda m, s: F.struct(m["type"].alias("type"), (s + m["skip"]).alias("start"), (m["length"] - m["skip"]).alias("length"), m["surrogate"].alias("surrogate")))
    none = F.array().cast("array<struct<type:string,start:int,length:int,surrogate:string>>")
    rows = rows.withColumn("starts", F.when(F.col("made").isNotNull(), starts))
    n = F.when(F.col("made").isNull(), 0).otherwise(F.size("made")).cast("long")
    return rows.select("doc_id", text.alias("text"), n.alias("n_entities"), F.lit(0).cast("long").alias("n_unchanged"), F.when(F.col("made").isNull(), none).otherwise(entities).alias("entities"))
