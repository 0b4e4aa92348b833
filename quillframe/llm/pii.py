"""Surrogates for personal data and secrets, in built-in SQL functions only.

Entities are found by one pattern. Each gets a keyed replacement of its own type and format: digits stay digits,
letters keep their case, punctuation stays, card numbers that pass the Luhn test pass it again, e-mail addresses of one
domain share a domain, and names keep title, gender, script and letter case.

A mention is made of parts that are settled on their own: a name of given names (of a gender) and a surname, an e-mail
address of a local part and a domain, any other mention of itself. So all mentions of a part, in whatever format, alone or
with others, in all documents, get one replacement: "Mr Smith" stays the "Mr Zed Smith" of before. A first draw depends on the
key and the part alone. A global pass over the distinct parts finds draws that two of them share, or that are themselves
an entity, and draws others for those; what draws do not part gets values that no other part has, counted through its
format. As different parts never share a replacement, neither do different entities.

Texts are searched once. Those without an entity go on as they are; those whose first draws were all free are rewritten
where they are; only those that hold a part with another draw take part in a join.
"""

from __future__ import annotations

from collections.abc import Callable
from secrets import token_hex

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.llm.common import durable, split_by

# Titles by gender, given names by gender and script, syllables of made-up surnames by script.
MALE_TITLES = "Mr|Herrn?|Monsieur|Señor|Sr|Господин"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Madame|Señora|Sra|Mme|Mlle|Госпожа"
OTHER_TITLES = "Dr|Prof|Mx"
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leon", "Martin", "Nico", "Oscar", "Paul", "Rafael", "Simon", "Tomas", "Victor"],
    ("latin", "f"): ["Alma", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Paula", "Rosa", "Sofia", "Teresa", "Vera"],
    ("latin", "n"): ["Alex", "Andrea", "Charlie", "Dominique", "Eden", "Jo", "Kim", "Lou", "Morgan", "Noa", "Robin", "Sam", "Sascha", "Toni"],
    ("cyrillic", "m"): ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Максим", "Олег"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Ксения", "Мария", "Нина", "Ольга"],
    ("cyrillic", "n"): ["Женя", "Саша", "Валя", "Слава"],
    ("greek", "m"): ["Αντώνης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ζωή", "Κατερίνα", "Μαρία", "Σοφία"],
    ("greek", "n"): ["Αλέξις", "Χάρις"],
}
SYLLABLES = {
    "latin": ["ba", "bel", "cor", "da", "del", "fer", "ga", "gor", "hal", "ka", "kel", "la", "len", "lor", "ma", "mer", "mon", "na", "nel", "nor", "pa", "per", "ra", "rin", "sa", "sel", "ta", "ten", "tor", "va", "vel", "wen"],
    "cyrillic": ["ба", "бел", "ва", "вол", "га", "гор", "да", "дел", "ка", "ков", "ла", "лен", "ма", "мор", "на", "нов", "па", "пет", "ра", "рин", "са", "сел", "та", "тор"],
    "greek": ["βα", "γα", "δε", "κα", "κο", "λα", "λε", "μα", "μι", "να", "νο", "πα", "πε", "ρα", "σα", "τα", "το"],
}
#: Words of a surname that stay as they are, in any letter case, and beginnings and ends that do within a word.
PARTICLES = "van|von|vom|der|den|de|del|della|di|da|dos|du|la|le|ter|ten|zu|zum|bin|ibn|al|el"
PREFIXES, SUFFIX = ("o", "d", "l", "mc", "mac"), "s"
#: What a name is made of: runs of letters between spaces, hyphens, apostrophes and inner capitals.
UNIT = r"\p{Lu}{2,}(?!\p{Ll})|\p{Lu}[\p{L}&&\P{Lu}]*|[\p{L}&&\P{Lu}]+"
#: Names as the pattern takes them: one or two titles and up to three capitalised words, particles not counted.
_TITLES = rf"(?:(?:{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES})\.? {{1,2}}){{1,2}}"
_WORD = rf"(?:(?i:{PARTICLES}) ){{0,3}}\p{{Lu}}[\p{{L}}'’-]++"
_NAME = rf"(?<![\p{{L}}\p{{N}}]){_TITLES}{_WORD}(?: {_WORD}){{0,2}}"
_SECRET_NAME = r"(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: A value after ``=`` or a bare colon is one; after a colon and a space, as in prose, it is quoted or holds more than letters.
_SIGN = r"(?:=|:(?! )|:(?= {1,2}(?:[\"']|[A-Za-z0-9_+/.~-]*[0-9_+/~])))"
#: In order of preference where two could begin at one place. Every repetition is bounded, or begins after a boundary and gives nothing back, so that the time stays in proportion to the text and an entity of any length is taken whole.
KINDS = {
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": rf"(?<![A-Za-z0-9])(?i:{_SECRET_NAME}) {{0,2}}{_SIGN} {{0,2}}[\"']?[A-Za-z0-9_+/.~-]{{8,}}+",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+(?!\d{1,3}\.\d+(?![ .()-]?[\d(]))\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4})(?!\d)",
    "name": _NAME,
}
PATTERN = "|".join(KINDS.values())
#: What any entity holds; texts without it are passed on as they are.
HINT = rf"[@\d]|(?:AKIA|ASIA)[A-Z]{{16}}|(?i:{_SECRET_NAME}) {{0,2}}[=:]|(?:{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES})\.? "
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Kinds whose values have a fixed form, and the characters at its beginning that stay; a form is crowded if more than a quarter of its values are entities.
FIXED = {"phone": 0, "ssn": 0, "card": 1, "iban": 2, "key": 4}
CROWDED, TURNS = 4, 8
#: Rounds of the collision check by other draws; entities that still clash then are placed by counting.
ROUNDS = 12
#: Characters of an entity that count, from its end, and values that are tried for a format at first.
COUNTED, TRIED = 10, 1024
#: Kinds of parts whose replacements may be longer than the part, where its format has no value left.
LONGER = ("email", "domain", "secret", "given", "surname")
#: Kinds of parts that never stand alone: a replacement may be another entity's part, but not the part itself.
PARTIAL = ("email", "given")
#: Stands around the mentions of a text while it is cut; texts that hold it are cut in another way.
MARK = "\x01"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body names it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def _kind(e: Column) -> Column:
    out = F.lit("name")
    for kind in ("phone", "ssn", "card", "iban", "ip", "email", "secret", "key"):
        out = F.when(e.rlike(f"^(?:{KINDS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def _secret_value(e: Column) -> Column:
    return F.regexp_extract(e, rf"^(?i:{_SECRET_NAME}) *[=:] *[\"']?(.*)$", 1)


def _script(n: Column, latin, cyrillic, greek) -> Column:
    return F.when(n.rlike(r"\p{IsCyrillic}"), cyrillic).when(n.rlike(r"\p{IsGreek}"), greek).otherwise(latin)


def _parts(kind: Column, e: Column) -> Column:
    """The parts of a mention, as an array of (kind, norm): what mentions of one part have in common.

    An e-mail address is ('email', address), which stands for its local part, and ('domain', domain); a name is ('surname', unit) for
    what its last word is made of and ('given', gender:unit) for the words before it, but ('particle', unit) for what stays as it is. The gender is that of the titles or, where they have none, of the given name if it is listed.
    """
    titles = F.regexp_extract(e, f"^{_TITLES}", 0)
    of_titles = F.when(titles.rlike(rf"(?:^| )(?:{MALE_TITLES})\.? "), "m").when(titles.rlike(rf"(?:^| )(?:{FEMALE_TITLES})\.? "), "f")
    part = lambda kind, norm: F.struct(kind.alias("kind"), norm.alias("norm"))

    def given(w: Column, of_titles: Column) -> Column:
        known = F.lit("n")
        for g in "mf":
            known = F.when(w.isin([x.lower() for (_, h), names in GIVEN.items() for x in names if g == h]), g).otherwise(known)
        return part(F.lit("given"), F.concat_ws(":", F.coalesce(of_titles, known), w))

    def unit(x: Column, u: Column, i: Column) -> Column:
        low, n = F.lower(u), F.size(x["units"])
        end = n - F.when((n > 1) & (F.lower(F.element_at(x["units"], -1)) == SUFFIX), 1).otherwise(0)  # an 's behind a name is no part of it
        joined = ~F.contains(F.get(x["gaps"], i + 1), F.lit(" "))
        stays = (i >= end) | ((i < end - 1) & (low.isin(PARTICLES.split("|")) | (joined & low.isin(*PREFIXES))))
        return F.when(stays, part(F.lit("particle"), low)).when(i >= x["last"], part(F.lit("surname"), low)).otherwise(given(low, x["sex"]))

    rest = F.substring(e, F.length(titles) + 1, F.length(e))
    gaps = F.split(rest, UNIT, -1)
    last = F.array_max(F.transform(gaps, lambda g, i: F.when(F.contains(g, F.lit(" ")), i).otherwise(0)))
    name = _let(F.struct(F.regexp_extract_all(rest, F.lit(UNIT), F.lit(0)).alias("units"), gaps.alias("gaps"), last.alias("last"), of_titles.alias("sex")), lambda x: F.transform(x["units"], lambda u, i: unit(x, u, i)))
    email = _let(F.lower(e), lambda x: F.array(part(F.lit("email"), x), part(F.lit("domain"), F.regexp_extract(x, "@(.*)$", 1))))
    norm = (
        F.when(kind.isin("card", "ssn"), F.regexp_replace(e, "[^0-9]", ""))
        .when(kind == "phone", F.regexp_replace(F.regexp_replace(e, "[^0-9]", ""), r"^1(\d{10})$", "$1"))  # with or without the country's 1
        .when(kind == "iban", F.regexp_replace(e, " ", ""))
        .when(kind == "secret", _secret_value(e))
        .otherwise(e)
    )
    return F.when(kind == "email", email).when(kind == "name", name).otherwise(F.array(part(kind, norm)))


def _value(kind: Column, n: Column) -> Column:
    """What a replacement of the part stands in for."""
    return F.when(kind == "given", F.substring(n, F.lit(3), F.length(n))).otherwise(n)


def _short(s: Column) -> Column:
    """What stands for ``s`` in a seed, which is digested once for every 32 characters: a long text by its own digest."""
    return F.when(F.length(s) > 200, F.sha2(s.cast("binary"), 256)).otherwise(s)


def _stream(seed: Column, n: Column) -> Column:
    """Blocks of 64 hexadecimal digits from the seed, two digits for each of ``n`` characters at least."""
    return F.transform(F.sequence(F.lit(0), (n / 32).cast("int")), lambda b: F.sha2(F.concat(seed, b.cast("string")).cast("binary"), 256))


def _byte(digits: Column, i: Column) -> Column:
    return F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _drawn(stream: Column, i: Column) -> Column:
    """The i-th byte of the blocks, at the same cost wherever it is."""
    return _byte(F.element_at(stream, F.shiftright(i, 5) + 1), i % 32)


def _at(letters: str, i: Column) -> Column:
    return F.substring(F.lit(letters), i % len(letters) + 1, F.lit(1))


def _scramble(s: Column, seed: Column) -> Column:
    """Other characters of the same classes: digits, small and capital letters; hexadecimal stays hexadecimal. The first digit is 0 only if it was."""
    small = F.when(s.rlike("^[0-9a-f]{8,}$") & s.rlike("[a-f]"), F.lit(6)).otherwise(F.lit(26))

    def one(c: Column, i: Column, stream: Column, letters: Column) -> Column:
        v = _drawn(stream, i)
        digit = F.when((i == 0) & (c != "0"), v % 9 + 1).otherwise(v % 10).cast("string")
        return F.when(c.between("0", "9"), digit).when(c.between("a", "z"), F.substring(F.lit(LOWER), v % letters + 1, F.lit(1))).when(c.between("A", "Z"), _at(UPPER, v)).otherwise(c)

    drawn = F.struct(_stream(seed, F.length(s)).alias("stream"), small.alias("letters"))
    return _let(drawn, lambda d: F.array_join(F.transform(F.split(s, ""), lambda c, i: one(c, i, d["stream"], d["letters"])), ""))


def _luhn_sum(digits: Column, last_doubled: bool) -> Column:
    """Sum of the digits with every second one doubled, counted from the right."""
    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == (0 if last_doubled else 1), F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    values = F.transform(F.split(F.reverse(digits), ""), part)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _card(n: Column, seed: Column) -> Column:
    new = F.concat(F.substring(n, 1, 1), _scramble(F.substring(n, F.lit(2), F.length(n)), seed))  # the issuer's digit stays

    def checked(body: Column) -> Column:
        return F.concat(body, ((10 - _luhn_sum(body, True) % 10) % 10).cast("string"))

    return _let(new, lambda x: F.when(_luhn_sum(n, False) % 10 == 0, _let(F.substring(x, F.lit(1), F.length(n) - 1), checked)).otherwise(x))


def _pick(words: list[str], v: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), v % len(words) + 1)


def _spelled(n: Column, stream: Column, count: Column) -> Column:
    """So many made-up syllables in the script of ``n``."""
    spell = lambda x: F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: _pick(x, _byte(stream, i.cast("int")))), "")
    return _script(n, *(spell(SYLLABLES[s]) for s in ("latin", "cyrillic", "greek")))


def _given(n: Column, key: str, attempt: Column) -> Column:
    """A listed name of the gender and script, another than its own, with made-up syllables after it from the second draw on."""
    drawn = F.sha2(F.concat_ws("|", F.lit(key), F.lit("given"), _short(n), attempt.cast("string")).cast("binary"), 256)

    def other(words: list[str], v: Column) -> Column:
        return F.when(_pick(words, v) == _value(F.lit("given"), n), _pick(words, v + 1)).otherwise(_pick(words, v))

    def choose(stream: Column) -> Column:
        listed = F.lit(None).cast("string")
        for g in "mfn":
            of = [other([x.lower() for x in GIVEN[s, g]], _byte(stream, F.lit(0))) for s in ("latin", "cyrillic", "greek")]
            listed = F.when(n.startswith(g), _script(n, *of)).otherwise(listed)
        return F.when(attempt == 0, listed).otherwise(F.concat(listed, _spelled(n, stream, F.least(attempt + 1, F.lit(20)))))

    return _let(drawn, choose)


def _surname(n: Column, key: str, attempt: Column) -> Column:
    drawn = F.sha2(F.concat_ws("|", F.lit(key), F.lit("surname"), _short(n), attempt.cast("string")).cast("binary"), 256)
    return _let(drawn, lambda x: _spelled(n, x, F.lit(4) + F.least(attempt, F.lit(20))))


def _surrogate(kind: Column, n: Column, attempt: Column, key: str) -> Column:
    """The replacement of a part. That of an 'email' is another local part before the old domain, which is a part of its own."""
    seed = F.concat_ws("|", F.lit(key), kind, _short(n), attempt.cast("string"), F.lit(""))
    email = F.concat(_scramble(F.regexp_extract(n, "^([^@]*)@", 1), seed), F.regexp_extract(n, "(@.*)$", 1))
    domain = F.concat(_scramble(F.regexp_extract(n, r"^(.*)\.[^.]*$", 1), seed), F.regexp_extract(n, r"(\.[^.]*)$", 1))
    ip = _let(_stream(seed, F.lit(4)), lambda x: F.array_join(F.transform(F.split(n, r"\."), lambda _, i: (_drawn(x, i) % 254 + 1).cast("string")), "."))
    iban = F.concat(F.substring(n, 1, 2), _scramble(F.substring(n, F.lit(3), F.length(n)), seed))
    access = F.concat(F.substring(n, 1, 4), _scramble(F.substring(n, F.lit(5), F.length(n)), seed))
    return (
        F.when(kind == "email", email)
        .when(kind == "particle", n)
        .when(kind == "domain", domain)
        .when(kind == "ip", ip)
        .when(kind == "card", _card(n, seed))
        .when(kind == "iban", iban)
        .when(kind == "key", access)
        .when(kind == "given", _given(n, key, attempt))
        .when(kind == "surname", _surname(n, key, attempt))
        .otherwise(_scramble(n, seed))
    )


def _fill(mould: Column, core: Column, members: str) -> Column:
    """The characters of ``core`` in the places of ``mould`` that hold ``members``; other characters stay."""
    start = F.struct(F.lit("").alias("out"), core.alias("rest"))

    def one(a: Column, c: Column) -> Column:
        return F.when(c.rlike(members), F.struct(F.concat(a["out"], F.substring(a["rest"], 1, 1)).alias("out"), F.substring(a["rest"], F.lit(2), F.length(a["rest"])).alias("rest"))).otherwise(
            F.struct(F.concat(a["out"], c).alias("out"), a["rest"].alias("rest"))
        )

    return F.aggregate(F.split(mould, ""), start, one, lambda a: a["out"])


def _capitals(new: Column, old: Column) -> Column:
    """``new`` with capitals in the places of those of ``old``."""
    cased = F.array_join(F.zip_with(F.split(new, ""), F.split(old, ""), lambda c, o: F.when(o != F.lower(o), F.upper(c)).otherwise(F.coalesce(c, F.lit("")))), "")
    return F.when(old == F.lower(old), new).otherwise(cased)


def _dress(kind: Column, e: Column, cores: Column) -> Column:
    """The replacements of a mention's parts in the format of the mention ``e``."""
    core, value, lead = F.element_at(cores, 1), _secret_value(e), F.regexp_extract(e, f"^{_TITLES}", 0)
    cased = lambda w, o: F.when((o == F.upper(o)) & (F.length(o) > 1), F.upper(w)).when(o == F.lower(o), w).otherwise(F.initcap(w))

    def named(x: Column) -> Column:
        return F.concat(F.array_join(F.transform(x["units"], lambda u, i: F.concat(F.get(x["gaps"], i), cased(F.get(cores, i), u))), ""), F.element_at(x["gaps"], -1))

    rest = F.substring(e, F.length(lead) + 1, F.length(e))
    name = F.concat(lead, _let(F.struct(F.split(rest, UNIT, -1).alias("gaps"), F.regexp_extract_all(rest, F.lit(UNIT), F.lit(0)).alias("units")), named))
    email = F.concat(_capitals(F.regexp_extract(core, "^([^@]*)@", 1), F.regexp_extract(e, "^([^@]*)@", 1)), F.lit("@"), _capitals(F.element_at(cores, -1), F.regexp_extract(e, "@(.*)$", 1)))
    digits = F.length(F.regexp_replace(e, "[^0-9]", ""))
    return (
        F.when(kind == "secret", F.concat(F.substring(e, F.lit(1), F.length(e) - F.length(value)), core))
        .when(kind == "email", email)
        .when(kind.isin("card", "ssn", "phone"), _fill(e, F.when(digits > F.length(core), F.concat(F.lit("1"), core)).otherwise(core), "[0-9]"))
        .when(kind == "iban", _fill(e, core, "[A-Z0-9]"))
        .when(kind == "name", name)
        .otherwise(core)
    )


def _found(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _body(kind: Column, n: Column) -> tuple[Column, Column, Column]:
    """Of an entity of fixed form: how many characters at its beginning stay, by how much a card's last digit is off its check digit (null for other
    kinds), and what is between."""
    lead = F.lit(0)
    for name, size in FIXED.items():
        lead = F.when(kind == name, size).otherwise(lead)
    off = F.when(kind == "card", _luhn_sum(F.when(kind == "card", n).otherwise("0"), False) % 10)
    return lead, off, F.substring(n, lead + 1, F.length(n) - lead - off.isNotNull().cast("int"))


def _exchanged(kind: Column, n: Column, key: str) -> Column:
    """Another value of the same fixed form, by a keyed permutation of all of them that leaves none where it is.

    The permutation is one step around a circle of all values, seen through a Feistel network on their characters: each half in turn is
    moved by a digest of the other, place by place, within the class of each character.
    """
    lead, off, body = _body(kind, n)

    def place(c: Column, i: Column, whole: Column) -> Column:
        """(what is counted from, how many there are, which this is) of a character; the first of a number is 0 only if it was, and 11 digits do not begin with 1."""
        opens = (i == 0) & (lead == 0)
        least = F.when(F.length(n) == 11, 2).otherwise(1)
        made = lambda base, size, at: F.struct(base.alias("base"), F.lit(size).cast("int").alias("size") if isinstance(size, int) else size.cast("int").alias("size"), at.cast("int").alias("at"))
        digit = c.between("0", "9")
        return (
            F.when(digit & opens & (c != "0"), made(F.lit(48) + least, 10 - least, c.cast("int") - least))
            .when(digit & opens, made(F.lit(48), 1, F.lit(0)))
            .when(digit, made(F.lit(48), 10, c.cast("int")))
            .when(c.between("A", "Z"), made(F.lit(65), 26, F.ascii(c) - 65))
            .when(c.between("a", "z"), made(F.lit(97), 26, F.ascii(c) - 97))
            .otherwise(made(F.ascii(c), 1, F.lit(0)))
        )

    def permuted(places: Column) -> Column:
        half = F.floor(F.size(places) / 2).cast("int")

        def turn(sign: int):
            def one(values: Column, r: Column) -> Column:
                left = r % 2 == 0
                other = F.when(left, F.slice(values, half + 1, F.size(values) - half)).otherwise(F.slice(values, F.lit(1), half))
                moved = F.sha2(F.concat_ws("|", F.lit(key), F.lit("exchange"), kind, r.cast("string"), F.array_join(F.transform(other, lambda v: v.cast("string")), ",")).cast("binary"), 256)
                return _let(moved, lambda d: F.transform(values, lambda v, i: F.when((i < half) == left, F.pmod(v + _byte(d, i % 32) * sign, F.get(places, i)["size"])).otherwise(v)))

            return one

        turns = F.sequence(F.lit(0), F.lit(TURNS - 1))
        seen = F.aggregate(turns, F.transform(places, lambda x: x["at"]), turn(1))
        step = lambda values: F.transform(values, lambda v, i: F.when(i == F.size(values) - 1, F.pmod(v + 1, F.get(places, i)["size"])).otherwise(v))
        back = F.aggregate(F.reverse(turns), _let(seen, step), turn(-1))
        return F.array_join(F.zip_with(places, back, lambda p, v: F.char(p["base"] + v)), "")

    new = _let(F.transform(F.split(body, ""), lambda c, i: place(c, i, body)), permuted)
    bare = F.concat(F.substring(n, F.lit(1), lead), new)
    return _let(bare, lambda x: F.when(off.isNotNull(), F.concat(x, ((10 - _luhn_sum(x, True) % 10 + off) % 10).cast("string"))).otherwise(x))


def crowded_forms(parts: DataFrame, key: str) -> DataFrame:
    """(kind, norm, core) of the entities of crowded forms, such as short numbers: all of one form get values of the permutation, so
    that no free value has to be found. A form is kind, length, classes of characters, and what stays. Numbers of entities are all that is compared."""
    kind, n = F.col("kind"), F.col("norm")
    lead, off, body = _body(kind, n)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a")
    many = lambda c: F.length(F.regexp_replace("classes", f"[^{c}]", ""))
    formed = parts.where(kind.isin(*FIXED)).select("kind", "norm", classes.alias("classes"), F.concat_ws("|", F.substring(n, F.lit(1), lead), n.startswith("0").cast("string"), off.cast("string")).alias("form"))
    counted = formed.groupBy("kind", "classes", "form").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") * CROWDED > 0.8 * F.pow(F.lit(10.0), many("0")) * F.pow(F.lit(26.0), many("Aa")))
    return formed.join(counted, ["kind", "classes", "form"]).select("kind", "norm", _exchanged(kind, n, key).alias("core"))


def _choices(kind: Column, n: Column, body: Column, end: Column) -> Column:
    """What may stand at each place of ``end``, the counted end of ``body``: the same classes as in ``_scramble``."""
    chars = lambda x: F.split(F.lit(x), "")
    small = F.when(body.rlike("^[0-9a-f]{8,}$") & body.rlike("[a-f]"), chars("abcdef")).otherwise(chars(LOWER))

    def one(c: Column, i: Column) -> Column:
        digit = F.when((i == 0) & (c != "0") & (F.length(end) == F.length(body)), chars("123456789")).otherwise(chars("0123456789"))
        return F.when(c.between("0", "9"), digit).when(c.between("a", "z"), small).when(c.between("A", "Z"), chars(UPPER)).otherwise(F.array(c))

    octets = F.transform(F.sequence(F.lit(1), F.lit(254)), lambda x: x.cast("string"))
    dotted = F.transform(octets, lambda x: F.concat(F.lit("."), x))
    words = lambda x: F.array(*map(F.lit, x))
    surname = _script(n, *(F.array_repeat(words(SYLLABLES[s]), 5) for s in ("latin", "cyrillic", "greek")))
    given = F.array().cast("array<array<string>>")
    for g in "mfn":
        of = (F.concat(F.array(words([x.lower() for x in GIVEN[s, g]])), F.array_repeat(words(SYLLABLES[s]), 3)) for s in ("latin", "cyrillic", "greek"))
        given = F.when(n.startswith(g), _script(n, *of)).otherwise(given)
    return F.when(kind == "ip", F.array(octets, dotted, dotted, dotted)).when(kind == "surname", surname).when(kind == "given", given).otherwise(F.transform(F.split(end, ""), one))


def _formats(left: DataFrame) -> DataFrame:
    """(kind, norm, core) with the format of its replacements: ``head``, one of ``choices`` for each place, a check digit
    for ``luhn``, ``tail``; ``gid`` tells formats apart."""
    kind, n, core = F.col("kind"), F.col("norm"), F.col("core")
    luhn = (kind == "card") & (_luhn_sum(F.when(kind == "card", n).otherwise("0"), False) % 10 == 0)
    whole = kind.isin("ip", "given", "surname")
    lead = F.when(whole, F.length(n)).when(kind == "card", 1).when(kind == "iban", 2).when(kind == "key", 4).otherwise(0)
    tail = F.when(kind == "email", F.regexp_extract(core, "(@.*)$", 1)).when(kind == "domain", F.regexp_extract(core, r"(\.[^.]*)$", 1)).otherwise("")
    size = F.length(n) - lead - luhn.cast("int") - F.length(tail)
    body = F.substring(n, lead + 1, size)
    end = F.reverse(F.regexp_extract(F.reverse(body), rf"^(?:[^A-Za-z0-9]*+[A-Za-z0-9]){{0,{COUNTED}}}", 0))
    drawn = F.substring(core, F.lit(1), lead + size - F.length(end))
    head = F.when(whole, "").otherwise(drawn)
    out = left.select("kind", "norm", head.alias("head"), _choices(kind, n, body, end).alias("choices"), luhn.alias("luhn"), tail.alias("tail"))
    return out.withColumn("gid", _format_id())


def _format_id() -> Column:
    places = F.array_join(F.transform("choices", lambda x: F.array_join(x, "")), "|")
    return F.sha2(F.concat_ws("|", "kind", "head", places, F.col("luhn").cast("string"), "tail").cast("binary"), 256)


def _place(left: DataFrame, held: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """(kind, norm, core) for all of ``left`` (kind, norm, core): values of the entity's format that no two have and that
    are not ``held`` (kind, core).

    The values of each format are counted from a place that the key decides. Where all are held, replacements get one
    place more; those of kinds of a fixed length may then be another entity, if no replacement is (``taken``: kind, core).
    """
    left, reach, placed = durable(_formats(left), "formats"), 1, None
    while True:
        groups = left.groupBy("gid").agg(F.count(F.lit(1)).alias("m"), *(F.any_value(c).alias(c) for c in ("kind", "head", "choices", "luhn", "tail")))
        room = F.aggregate("choices", F.lit(1).cast("long"), lambda a, x: a * F.size(x))
        groups = groups.withColumn("room", room).withColumn("tries", F.least("room", F.greatest(F.lit(TRIED), F.col("m") * 4) * reach))
        groups = groups.withColumn("start", F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(f"start {reach}"), "gid").cast("binary"), 256), 1, 12), 16, 10).cast("long"))
        groups = durable(groups, "groups")
        blocks = groups.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tries") - 1, F.lit(TRIED).cast("long")))).repartition("gid", "at")
        tried = blocks.withColumn("r", F.explode(F.sequence("at", F.least(F.col("at") + (TRIED - 1), F.col("tries") - 1))))
        first = F.struct(((F.col("start") + F.col("r")) % F.col("room")).alias("rest"), F.lit("").alias("out"))

        def spell(a: Column, x: Column) -> Column:
            size = F.size(x).cast("long")
            return F.struct(F.call_function("div", a["rest"], size).alias("rest"), F.concat(F.element_at(x, (a["rest"] % size + 1).cast("int")), a["out"]).alias("out"))

        bare = F.concat("head", F.aggregate(F.reverse("choices"), first, spell, lambda a: a["out"]))
        digit = F.when(F.col("luhn"), ((10 - _luhn_sum(F.when(F.col("luhn"), F.col("bare")).otherwise("0"), True) % 10) % 10).cast("string")).otherwise("")
        values = tried.withColumn("bare", bare).select("gid", "kind", "r", F.concat("bare", digit, "tail").alias("core"))
        free = durable(values.join(held, ["kind", "core"], "left_anti"), "free")
        one = free.groupBy("kind", "core").agg(F.min(F.struct("gid", "r")).alias("of")).select("core", "of.*")  # of a value that two formats have
        ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("gid").orderBy("r")))
        keyed = F.sha2(F.concat_ws("|", F.lit(key), "norm").cast("binary"), 256)
        wanted = left.withColumn("rank", F.row_number().over(Window.partitionBy("gid").orderBy(keyed, "norm")))
        # A value that stays what it was is left for another round, unless its kind never stands alone.
        found = durable(wanted.join(ranked, ["gid", "rank"]).where((F.col("norm") != F.col("core")) | F.col("kind").isin(*PARTIAL)).select("kind", "norm", "core"), "placed")
        placed = found if placed is None else placed.unionByName(found)
        left = left.join(found, ["kind", "norm"], "left_anti")
        full = groups.where("tries = room").join(free, "gid", "left_anti").select("gid", F.lit(True).alias("full"))
        left = durable(left.join(full, "gid", "left"), "left")
        if left.isEmpty():
            return placed
        if not left.where(F.col("full") & ~F.col("kind").isin(*LONGER)).isEmpty():
            held = taken
        more = F.when(F.size(F.element_at("choices", -1)) > 1, F.slice("choices", -1, 1)).otherwise(F.array(F.split(F.lit(LOWER), "")))
        left = left.withColumn("choices", F.when(F.col("full") & F.col("kind").isin(*LONGER), F.concat("choices", more)).otherwise(F.col("choices"))).drop("full").withColumn("gid", _format_id())
        held, taken, reach = held.unionByName(found.select("kind", "core")), taken.unionByName(found.select("kind", "core")), reach * 4


def mentions_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(mark, e): the different mentions of each text that has any; texts are told apart by a hash."""
    return docs.select(F.xxhash64(text_col).alias("mark"), F.explode(F.array_distinct(_found(F.col(text_col)))).alias("e"))


def parts_of(mentions: DataFrame) -> DataFrame:
    """The columns of ``mentions`` but ``e``, with the kind and norm of each part."""
    others = [c for c in mentions.columns if c != "e"]
    return mentions.select(*others, F.explode(_parts(_kind(F.col("e")), F.col("e"))).alias("part")).select(*others, "part.kind", "part.norm").where("kind <> 'particle'")


def second_choices(mentions: DataFrame, key: str) -> DataFrame:
    """(kind, norm, core) of the parts whose first replacement is taken: by a smaller part, or as an entity."""
    parts = durable(parts_of(mentions.groupBy("e").agg(F.count(F.lit(1)).alias("n")).select("e")).distinct(), "parts")
    whole, kind = ~F.col("kind").isin(*PARTIAL), F.col("kind")
    crowded = durable(crowded_forms(parts, key), "crowded")
    assigned = (parts if crowded.isEmpty() else parts.join(crowded, ["kind", "norm"], "left_anti")).withColumn("attempt", F.lit(0))
    for _ in range(ROUNDS):
        drawn = durable(assigned.withColumn("core", _surrogate(kind, F.col("norm"), F.col("attempt"), key)), "surrogates")
        shared = drawn.groupBy("kind", "core").agg(F.min("norm").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        late = drawn.join(shared, ["kind", "core"]).where("norm <> first").select("kind", "norm")
        real = drawn.where(whole).join(parts.where(whole).withColumnRenamed("norm", "core"), ["kind", "core"], "left_semi").select("kind", "norm")
        same = drawn.where(F.col("core") == _value(kind, F.col("norm"))).select("kind", "norm")
        again = durable(late.union(real).union(same).distinct(), "taken")
        if again.isEmpty():
            return drawn.where("attempt > 0").select("kind", "norm", "core").unionByName(crowded)
        assigned = drawn.drop("core").join(again.withColumn("more", F.lit(1)), ["kind", "norm"], "left").select("kind", "norm", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt"))
    settled = drawn.join(again, ["kind", "norm"], "left_anti")
    held = settled.select("kind", "core").unionByName(parts.where(whole).select("kind", F.col("norm").alias("core")))
    placed = _place(drawn.join(again, ["kind", "norm"], "left_semi").select("kind", "norm", "core"), durable(held, "held"), settled.select("kind", "core"), key)
    return settled.where("attempt > 0").select("kind", "norm", "core").unionByName(placed).unionByName(crowded)


#: Keys of the applications that name none.
_KEYS: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The key that the cluster names in ``spark.quillframe.pii.key``: the same key gives the same surrogates. Without it, one that is drawn at
    random for this application and that nobody knows."""
    return spark.conf.get("spark.quillframe.pii.key", None) or _KEYS.setdefault(spark.sparkContext.applicationId, token_hex(32))


def _cut(text: Column) -> Column:
    """The text in pieces, every second one a mention: one search, unless the text holds the character that marks mentions."""
    marked = F.split(F.regexp_replace(text, F.lit(PATTERN), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    paired = F.flatten(F.zip_with(F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda p, e: F.array(p, F.coalesce(e, F.lit("")))))
    return F.when(text.contains(MARK), F.slice(paired, 1, F.size(paired) - 1)).otherwise(marked)


def replace_entities(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the entities of ``text_col`` replaced; all rows and columns stay, in the same order of columns.

    ``key`` is that of ``session_key`` where none is given. ``count_col`` adds the number of mentions, in place of a column of that name. A null text stays null and an empty one empty, with 0 mentions. Texts
    without an entity stay as they are, byte for byte. Ids are not read: they may be null or repeat, as a replacement depends
    on the part of an entity alone. Distinct parts get distinct replacements; other draws first, then values counted
    through the format, longer ones if an address, secret or name has no other. No replacement is an entity of the table, but for given names and
    the local parts of addresses, which only differ from their own, and for crowded forms (more than a quarter of whose values are entities),
    which exchange their values.
    """
    key = session_key(docs.sparkSession) if key is None else key
    if count_col:
        docs = docs.drop(count_col)
    mentions = durable(mentions_of(docs, text_col), "mentions")
    entries = durable(second_choices(mentions, key), "choices")
    taken = not entries.isEmpty()
    marked = docs.withColumn("__mark", F.xxhash64(text_col))
    none = F.lit(None).cast("map<string,string>").alias("__choices")
    half = split_by(marked, "__mark", mentions.select("mark"))
    plain, source = half(False), half(True).select("*", none)
    if taken:
        named = F.struct(F.concat_ws("|", "kind", "norm"), F.col("core"))
        # What a row needs depends on its text alone, so that rows alike need the same.
        needed = parts_of(mentions).distinct().join(entries, ["kind", "norm"])
        by_mark = durable(needed.groupBy("mark").agg(F.map_from_entries(F.collect_set(named)).alias("__choices")).withColumnRenamed("mark", "__of"), "choices-by-text")
        half = split_by(durable(half(True), "texts"), "__mark", by_mark)
        source = half(False).select("*", none).union(half(True).join(by_mark, F.col("__mark") == F.col("__of"), "left").drop("__of"))
    text = F.col(text_col)

    def core(part: Column) -> Column:
        first = _surrogate(part["kind"], part["norm"], F.lit(0), key)
        return F.coalesce(F.element_at(F.col("__choices"), F.concat_ws("|", part["kind"], part["norm"])), first) if taken else first

    def one(e: Column) -> Column:
        return _let(_kind(e), lambda kind: _let(F.transform(_parts(kind, e), core), lambda cores: _dress(kind, e, cores)))

    cut = source.withColumn("__cut", _cut(text))
    new = F.array_join(F.transform("__cut", lambda x, i: F.when(i % 2 == 1, one(x)).otherwise(x)), "")
    pick = lambda new: [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    changed, same = pick(new), pick(text)
    if count_col:
        changed.append(F.greatest(F.shiftright(F.size("__cut"), 1), F.lit(0)).alias(count_col))
        same.append(F.lit(0).alias(count_col))
    return plain.select(*same).union(cut.select(*changed))
