"""Operator 6 (native), personal data replaced by surrogates.

Detected entities are replaced by keyed surrogates of the same type: an e-mail address keeps its shape, its top
domain, its case and its script (Latin, Cyrillic or Greek; letters of others become Latin ones); an IP address is a
valid one of its version; a phone number keeps its layout, after a plus its country code, else its first digit; a
card number keeps its length, issuer digit and a valid check digit; an IBAN keeps its country and has valid check
digits; a titled person keeps title, gender, script, capitals and which names are given.  The same entity gets the same
surrogate in every document, whatever its layout or case.  Given and family names are entities of their own, so that
a full and a short form of one name stay one person.  A distributed collision check redraws until surrogates are
distinct and none equals an entity of the corpus.  Where a shape has too few values for that, redraws from the
``WIDEN``-th on are longer than the shape: more letters, digits or groups at its end.

Defined results: null and empty texts stay as they are; texts of any length are rewritten whole; at one place the
first kind of ``KINDS`` that fits is taken; repeated rows are each rewritten; an empty table gives none; other
columns pass through, and an ``n_pii`` of the input is replaced.  Card-like numbers that fail the check digit and
names without a title are left alone; different spellings of one IPv6 address are different entities; titles are
known in some languages, names in Latin, Cyrillic and Greek.  E-mail addresses are of letters and digits of any
script, without a limit of length.  A national phone number is one of ten digits in the North American manner, with
or without separators, or starts with 0 and has a space, hyphen or slash; others need a word like ``tel`` before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns, tried in this order at each place of the text
#: (repeats are of single characters or possessive, which Java matches without recursion, so that texts of any length do)
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?=[\p{L}\p{N}])[\p{L}\p{N}.-]*(?<=[\p{L}\p{N}])\.\p{L}{2,}(?![\p{L}\p{N}-])"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"
_H = "[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}}|:(?::{_H}){{1,7}}|(?:{_H}:){{1,7}}:)(?![\w:])"
PHONE = r"(?<![\w+])(?:\+(?=(?:[ .()-]{0,2}\d){7})\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}"
PHONE += r"|(?<![.,-])[2-9]\d{2}[2-9]\d{6}(?![.,-]\d)|(?<![./-])(?!\d\d[/-]\d\d[/-]\d{4})(?=0(?:[ /-]?\d){8,11}(?!\d))0\d{1,4}[ /-]\d{2,8}(?:[ -]\d{2,4}){0,3}"
PHONE += r"|(?i:tel|telefon|telephone|phone|fon|mobile|mobil|cell|fax)[.:]{0,2} {0,2}\d(?:[ ./-]?\d){6,13})(?!\w)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
#: Titles by gender; a person is a title and one or two capitalised names
MALE = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Señor", "Sr", "Don", "Monsieur", "господин", "г-н", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Lady", "Frau", "Señora", "Sra", "Srta", "Doña", "Madame", "Mme", "Mlle", "госпожа", "г-жа", "κυρία")
NEUTRAL = ("Dr", "Doctor", "Prof", "Professor", "доктор")
_TITLE = rf"(?<!\w)(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.? (?:(?:{'|'.join(NEUTRAL)})\.? ){{0,2}}"
_SCRIPT = r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]"
_UPPER, _LETTER = rf"[\p{{Lu}}&&{_SCRIPT}]", rf"[\p{{L}}&&{_SCRIPT}]"
_NAME = rf"{_UPPER}(?:{_LETTER}++|(?=['’]{_UPPER}))(?:['’]{_UPPER}{_LETTER}*+|-{_LETTER}++)*+"
PERSON = rf"{_TITLE}{_NAME}(?: {_NAME})?(?![\p{{L}}])"
KINDS = {"email": EMAIL, "ip": IP, "ip6": IP6, "ssn": SSN, "iban": IBAN, "phone": PHONE, "card": CARD, "person": PERSON}
ANY = "|".join(KINDS.values())
#: Country calling codes; those of three digits are what is left
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Given names by gender and script, and syllables of names
GIVEN = {
    ("m", "latin"): ("Adam", "Bruno", "Carl", "Daniel", "Erik", "Felix", "Georg", "Hugo", "Ivo", "Jonas", "Karl", "Leon", "Martin", "Noel", "Oscar", "Paul"),
    ("f", "latin"): ("Anna", "Bella", "Clara", "Dora", "Emma", "Flora", "Greta", "Helena", "Irma", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Тимур"),
    ("f", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья"),
    ("m", "greek"): ("Αλέξης", "Γιώργος", "Δημήτρης", "Κώστας", "Μάριος", "Νίκος", "Πέτρος", "Σπύρος"),
    ("f", "greek"): ("Άννα", "Ελένη", "Ζωή", "Κατερίνα", "Μαρία", "Νίκη", "Σοφία", "Χαρά"),
}
SYLLABLES = {
    "latin": ("ba", "ber", "da", "del", "fa", "gar", "ha", "kel", "la", "man", "na", "ran", "sa", "tor", "va", "wen"),
    "cyrillic": ("ба", "бер", "да", "дел", "ва", "гар", "ха", "кел", "ла", "ман", "на", "ран", "са", "тор", "за", "вен"),
    "greek": ("βα", "γα", "δα", "ζε", "θα", "κα", "λα", "μα", "να", "ξε", "πα", "ρα", "σα", "τα", "φα", "χα"),
}
#: letters of surrogate e-mail addresses by script
ALPHABETS = {"cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
HASHES, GROUPS = 5, 320
ROUNDS = 32
#: redraws from this one on are longer than the shape, by a character a redraw
WIDEN = 4


def _hex(h: Column, i, n: int = 2) -> Column:
    """The i-th group of n hex digits as a number."""
    at = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(h, at * n + 1, F.lit(n)), 16, 10).cast("long")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of digits with every second from the right doubled, over a string of digits."""
    twice = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(
        F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x
    )


def kind_of(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        ok = mention.rlike(f"^(?:{pattern})$")
        if kind == "card":
            ok = ok & (F.when(mention.rlike(r"^[0-9 -]+$"), luhn_sum(_digits(mention)) % 10) == 0)
        out = F.when(ok, F.lit(kind)).otherwise(out)
    return out


def parts_of(kind: Column, mention: Column) -> Column:
    """The entities that a mention refers to, as (slot, kind, entity): case, layout and titles set aside; a person has names."""
    names = F.split(F.lower(F.regexp_replace(mention, f"^{_TITLE}", "")), " ")
    of = lambda titles: mention.rlike(rf"^(?:{'|'.join(titles)})\.? ")
    gender = F.when(of(MALE), "m").when(of(FEMALE), "f").otherwise("x")
    part = lambda slot, k, e: F.struct(F.lit(slot).alias("slot"), k.alias("kind"), e.alias("entity"))
    given, family = part(0, F.concat(F.lit("given-"), gender), F.element_at(names, 1)), part(1, F.lit("family"), F.element_at(names, -1))
    entity = (
        F.when(kind.isin("email", "ip6"), F.lower(mention))
        .when(kind.isin("card", "ssn"), _digits(mention))
        .when(kind == "phone", F.concat(F.when(mention.startswith("+"), "+").otherwise(""), _digits(mention)))
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .otherwise(mention)
    )
    return F.when(kind != "person", F.array(part(0, kind, entity))).when(F.size(names) == 1, F.array(family)).otherwise(F.array(given, family))


def iban_check(iban: Column) -> Column:
    """The two check digits of an IBAN, whatever stands in their place."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 2), F.lit("00"))
    rest = F.aggregate(_chars(turned), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def surrogate_of(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """A surrogate entity; what it is depends on key, kind, entity and attempt alone."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, entity, attempt.cast("string"))
    h = F.concat(*[F.sha2(F.concat_ws("\x1f", seed, F.lit(str(i))), 512) for i in range(HASHES)])
    shape = lambda c, v: (
        F.when(c.rlike("[0-9]"), F.char((v % 10 + 48).cast("int")))
        .when(c.rlike("[a-z]"), F.char((v % 26 + 97).cast("int")))
        .when(c.rlike("[A-Z]"), F.char((v % 26 + 65).cast("int")))
        .when(c.rlike(r"\p{IsCyrillic}"), F.substring(F.lit(ALPHABETS["cyrillic"]), (v % len(ALPHABETS["cyrillic"]) + 1).cast("int"), F.lit(1)))
        .when(c.rlike(r"\p{IsGreek}"), F.substring(F.lit(ALPHABETS["greek"]), (v % len(ALPHABETS["greek"]) + 1).cast("int"), F.lit(1)))
        .when(c.rlike(r"\p{L}"), F.char((v % 26 + 97).cast("int")))
        .when(c.rlike(r"\p{N}"), F.char((v % 10 + 48).cast("int")))
        .otherwise(c)
    )
    same_shape = lambda s: F.array_join(F.transform(_chars(s), lambda c, i: shape(c, _hex(h, i % GROUPS))), "")
    wider = F.greatest(attempt - (WIDEN - 1), F.lit(0))
    more = lambda c: F.array_join(F.transform(F.slice(F.sequence(F.lit(0), wider), F.lit(2), wider), lambda i: shape(F.lit(c), _hex(h, GROUPS - i))), "")
    tld = F.regexp_extract(entity, r"(\.\p{L}+)$", 1)
    email = F.concat(more("a"), same_shape(F.regexp_replace(entity, r"\.\p{L}+$", "")), tld)
    ip = F.concat_ws(".", (_hex(h, 0) % 223 + 1).cast("string"), _hex(h, 1).cast("string"), _hex(h, 2).cast("string"), (_hex(h, 3) % 254 + 1).cast("string"))
    ip6 = F.array_join(F.transform(_chars(entity), lambda c, i: F.when(c == ":", c).otherwise(F.substring(h, i + 1, F.lit(1)))), "")
    full = F.concat_ws(":", *[F.substring(h, 4 * i + 1, 4) for i in range(8)])
    ip, ip6 = F.when(wider > 0, full).otherwise(ip), F.when(wider > 0, full).otherwise(ip6)
    n = F.length(entity)
    rest = lambda k: F.substring(entity, F.lit(k + 1), F.greatest(n - k, F.lit(1)))
    code = F.regexp_extract(entity, CALLING, 0)
    phone = F.when(code != "", F.concat(code, same_shape(F.substring(entity, F.length(code) + 1, n)))).otherwise(F.concat(F.substring(entity, 1, 1), same_shape(rest(1))))
    phone = F.concat(phone, more("0"))
    body = F.concat(F.substring(entity, 1, 1), same_shape(F.substring(entity, F.lit(2), F.greatest(n - 2, F.lit(1)))), more("0"))
    card = F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    account = F.concat(F.substring(entity, 1, 2), F.lit("00"), same_shape(rest(4)), more("0"))
    iban = F.concat(F.substring(account, 1, 2), iban_check(account), F.substring(account, F.lit(5), F.length(account)))
    pick = lambda a, v: F.element_at(F.array(*[F.lit(x) for x in a]), (v % len(a) + 1).cast("int"))

    def name(script: str) -> Column:
        # redraws add syllables, so that there are always names left
        syllables = lambda n: F.array_join(F.transform(F.slice(F.sequence(F.lit(1), n + 1), F.lit(2), n), lambda i: pick(SYLLABLES[script], _hex(h, i))), "")
        given = F.when(kind == "given-m", pick(GIVEN["m", script], _hex(h, 0))).when(kind == "given-f", pick(GIVEN["f", script], _hex(h, 0)))
        given = F.lower(given.otherwise(pick(GIVEN["m", script] + GIVEN["f", script], _hex(h, 0))))
        return F.when(kind == "family", syllables(attempt + 3)).otherwise(F.concat(given, syllables(F.greatest(attempt - 2, F.lit(0)))))

    named = F.when(entity.rlike(r"\p{IsCyrillic}"), name("cyrillic")).when(entity.rlike(r"\p{IsGreek}"), name("greek")).otherwise(name("latin"))
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "card", card).when(kind == "iban", iban)
    return out.when(kind == "phone", phone).when(kind == "ssn", F.concat(F.substring(entity, 1, 1), same_shape(rest(1)), more("0"))).otherwise(named)


def lay_out(kind: Column, mention: Column, surrogates: Column) -> Column:
    """The surrogates (a map from slots) in the mention's layout: separators, case and title stay; what is longer goes on at the end."""
    one = F.element_at(surrogates, 0)
    nth = lambda keep, i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), keep, "")).cast("int")
    digits = _digits(one)
    numbers = F.array_join(F.transform(_chars(mention), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, nth("[^0-9]", i), F.lit(1))).otherwise(c)), "")
    numbers = F.concat(numbers, F.substring(digits, F.length(_digits(mention)) + 1, F.length(digits)))
    ibans = F.array_join(F.transform(_chars(mention), lambda c, i: F.when(c != " ", F.substring(one, nth(" ", i), F.lit(1))).otherwise(c)), "")
    ibans = F.concat(ibans, F.substring(one, F.length(F.regexp_replace(mention, " ", "")) + 1, F.length(one)))
    cased = F.array_join(F.transform(_chars(one), lambda c, i: F.when(F.substring(mention, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    title = F.regexp_extract(mention, f"^({_TITLE})", 1)
    shouted = F.split(F.regexp_replace(mention, f"^{_TITLE}", ""), " ")
    named = lambda i: F.when(F.get(shouted, F.lit(i)).rlike(r"^[^\p{Ll}]{2,}$"), F.upper(F.element_at(surrogates, i))).otherwise(F.initcap(F.element_at(surrogates, i)))
    alone = F.size(shouted) == 1
    return (
        F.when(kind.isin("email", "ip6"), cased)
        .when(kind == "person", F.concat(title, F.when(alone, F.when(shouted[0].rlike(r"^[^\p{Ll}]{2,}$"), F.upper(F.element_at(surrogates, 1))).otherwise(F.initcap(F.element_at(surrogates, 1)))).otherwise(F.concat_ws(" ", named(0), named(1)))))
        .when(kind == "iban", ibans)
        .when(kind == "ip", one)
        .otherwise(numbers)
    )


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) with distinct surrogates that are no entities of any kind; entities must be distinct."""
    from .common import cut

    known = cut(entities.select(F.col("entity").alias("surrogate"), F.lit(True).alias("real")).distinct())
    a = entities.select("kind", "entity", F.lit(0).alias("attempt"))
    first = Window.partitionBy("surrogate").orderBy("attempt", "kind", "entity")
    for _ in range(ROUNDS):
        a = a.withColumn("surrogate", surrogate_of(F.col("kind"), F.col("entity"), F.col("attempt"), key))
        a = a.withColumn("place", F.row_number().over(first)).join(known, "surrogate", "left")
        a = cut(a.select("kind", "entity", "attempt", "surrogate", ((F.col("place") > 1) | F.col("real").isNotNull()).alias("clash")))
        if a.where("clash").isEmpty():
            return a.select("kind", "entity", "surrogate")
        a = a.select("kind", "entity", F.when(F.col("clash"), F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"))
    raise RuntimeError("surrogates still collide")


def replace(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_pii``: the number of mentions replaced.

    Whoever knows ``key`` can tell which surrogate an entity gets: keep it as secret as the texts.
    """
    from .common import cut

    if not key:
        raise ValueError("a key is needed")
    cols = [c for c in docs.columns if c != "n_pii"]
    hint = r"\d[ .()/-]*\d[ .()/-]*\d|::|(?:[0-9A-Fa-f]{1,4}:){3}|" + rf"{_TITLE}\p{{Lu}}"
    may = F.contains("text", F.lit("@")) | F.col("text").rlike(hint)
    has = F.coalesce(F.when(may, F.col("text").rlike(ANY)), F.lit(False))
    rest = docs.where(~has).select(*[docs[c] for c in cols], F.lit(0).alias("n_pii"))
    # the rows with matches are written once, so that their row numbers hold whatever is computed again
    hits = cut(docs.where(has).select(F.struct(*[docs[c] for c in cols]).alias("d"), F.col("text").alias("text"), F.monotonically_increasing_id().alias("row")))
    seen = hits.select("row", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))).alias("mention"))
    mentions = cut(seen.select("mention").distinct().withColumn("kind", kind_of(F.col("mention"))).where("kind is not null"))
    parts = cut(mentions.select("mention", F.col("kind").alias("of"), F.explode(parts_of(F.col("kind"), F.col("mention"))).alias("p")).select("mention", "of", "p.*"))
    chosen = parts.join(assign(parts.select("kind", "entity").distinct(), key), ["kind", "entity"])
    slots = chosen.groupBy("mention", "of").agg(F.map_from_entries(F.collect_list(F.struct("slot", "surrogate"))).alias("s"))
    swap = cut(slots.select("mention", lay_out(F.col("of"), F.col("mention"), F.col("s")).alias("to")))
    by_row = seen.join(swap, "mention").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("mention", "to"))).alias("swap"))
    j = hits.join(by_row, "row", "left")
    gaps, found = F.split("text", ANY, -1), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    new = F.transform(found, lambda m: F.coalesce(F.element_at("swap", m), m))
    text = F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), new.alias("r")), lambda x: F.array(x["g"], F.coalesce(x["r"], F.lit(""))))), "")
    n = F.when(F.col("swap").isNull(), 0).otherwise(F.coalesce(F.size(F.filter(found, lambda m: F.element_at("swap", m).isNotNull())), F.lit(0)))
    text = F.when(F.col("swap").isNull(), F.col("text")).otherwise(text)
    j = j.select("d", text.alias("text"), n.alias("n"))  # apart, so that no name of the input is met in a lambda
    return j.select(*[(F.col("text") if c == "text" else F.col("d").getField(c)).alias(c) for c in cols], F.col("n").alias("n_pii")).unionByName(rest)
