"""Surrogates for personal data, with DataFrame functions alone.

Detected kinds: e-mail addresses, IPv4 addresses, IBANs, social security numbers,
phone numbers, card numbers, and names after a title. Each distinct entity gets
one replacement made from a keyed SHA-512 digest of its kind and normal form:

* characters keep their class and place (digits for digits, separators kept), a
  phone its country code, a card its first digit and, if it passes the Luhn test,
  a last digit that passes it too, a host its reserved example domain;
* a name keeps titles, gender (of the titles), script and number of parts. The last
  part is the surname. Given names and surnames are replaced separately, so a person
  is the same with and without given names; particles stay, initials are rotated in
  their alphabet by a keyed amount, a possessive ending stays;
* capitalised words of a text that are a part of a name found in the same text are
  replaced like that part, so untitled mentions do not give the name away;
* the normal form ignores case of addresses and separators of numbers, so
  mentions that mean the same get the same replacement in their own format.

Distinct entities get distinct replacements: of those that collide, or that hit a
real entity of the corpus, all but the one with the smallest normal form draw
again, in rounds, until none collides. Only entities are compared, not texts.

Names are only found by a title and a capital letter: a person who is never named
with a title stays, as does a name in lower case. Titles without a gender (Dr, Prof)
give names of a third kind; where surnames have a gender, such a mention and one with
a gendered title get different surnames. Runs of 13 to 19 digits count as cards
whether they pass the Luhn test or not: hiding a number too many is the lesser fault.

Null and empty texts stay as they are, and null ids stay null. Rows that repeat get
equal rows. Without rows there is no result. A text without an entity is not shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import documents
from murmur.session import materialise

ROUNDS = 60

# begins where its run begins and never steps back, so long runs cost their length once
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,10}+"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
PHONE = (
    r"(?<![A-Za-z0-9+])\+?[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![A-Za-z0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
    r"|(?<![A-Za-z0-9.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9-])"
)
CARD = r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])"
#: Titles by gender; a name follows.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "г-н", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа", "г-жа", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Professor")
PARTICLES = "von van der den de del della di da du la le zu zum zur bin ibn al el ten ter dos das".split()
_SPELLED = sorted({t for w in MALE + FEMALE + NEUTRAL for t in (w, w.upper())}, key=lambda t: (-len(t), t))
_TITLE = "(?:" + "|".join(_SPELLED) + r")\.?"
_TITLES = rf"{_TITLE}(?: {_TITLE}){{0,2}}"
# letters, and inner apostrophes and hyphens but for a possessive ending; no beginning of an address
_FREE = r"(?![\p{L}\p{N}._%+-]{0,64}+@)"
_PART = r"\p{Lu}(?:\p{L}|['’-](?!s(?!\p{L}))(?=\p{L}))++" + _FREE
_INITIAL = r"\p{Lu}\."
_PARTICLE = "(?:" + "|".join(PARTICLES) + ")"
NAME = rf"(?<![\p{{L}}\p{{N}}]){_TITLES} (?:(?:{_PART}|{_INITIAL}|{_PARTICLE}) ){{0,5}}{_PART}"
#: A word that may repeat a part of a name; it neither begins an address nor hides a title.
WORD = (
    rf"(?<![\p{{L}}\p{{N}}])\p{{Lu}}(?:\p{{L}}|['’-](?!s(?!\p{{L}}))(?!{_TITLE} )(?=\p{{L}}))++"
    + _FREE
)

KINDS = (("email", EMAIL), ("ip", IP), ("iban", IBAN), ("ssn", SSN), ("phone", PHONE), ("card", CARD), ("name", NAME))
ENTITY = "|".join(f"(?:{pattern})" for _, pattern in KINDS)
#: For texts with a name.
WIDE = f"{ENTITY}|(?:{WORD})"
#: What every text with an entity has; cheaper than the patterns.
HINT = "[0-9@]|" + "|".join(_SPELLED)

#: Alphabets in which initials are rotated.
ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
#: Syllables of made-up names by script: beginnings, middles, endings by gender, surname endings by gender.
SYLLABLES = {
    "latin": ("Al Be Ca Da El Fa Ga Ha Is Jo Ka Li Ma No Or Pe".split(), "ra li ne do ma ri to sa vi lo na ke mi ro be ta".split(),
              {"f": "na", "m": "n", "x": "r"}, {"any": "berg"}),
    "cyrillic": ("Ал Бо Ве Га Да Ев Жа Зо Ил Ка Ле Ма Ни Ол Па Ро".split(), "ра ли не до ма ри то са ви ло на ке ми ро бе та".split(),
                 {"f": "на", "m": "н", "x": "л"}, {"f": "рова", "m": "ров", "x": "ренко"}),
    "greek": ("Αλ Βα Γε Δα Ελ Ζα Ηλ Θε Ιω Κα Λε Μα Νι Ορ Πα Ρο".split(), "ρα λι νε δο μα ρι το σα βι λο να κε μι ρο βε τα".split(),
              {"f": "να", "m": "νος", "x": "ρις"}, {"f": "ίδη", "m": "ίδης", "x": "άκου"}),
}


def kind_of(mention: Column) -> Column:
    """The first kind whose pattern is the whole mention."""
    out = F.when(mention.rlike(rf"^{_TITLES} "), "name").otherwise("word")
    for kind, pattern in reversed(KINDS[:-1]):
        out = F.when(mention.rlike(rf"^(?:{pattern})$"), kind).otherwise(out)
    return out


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def pieces_of(mention: Column) -> Column:
    """The words of a name behind its titles."""
    return F.split(F.regexp_replace(mention, rf"^{_TITLES} ", ""), " ")


def stays(piece: Column) -> Column:
    """Initials and particles are no entities."""
    return piece.rlike(rf"^(?:{_INITIAL}|{_PARTICLE})$")


def entities_of(mention: Column, kind: Column) -> Column:
    """Array of (part, kind, norm): one of part 0, or the parts of a name by their place."""
    titles = F.regexp_extract(mention, rf"^({_TITLES}) ", 1)

    def titled(words: tuple) -> Column:
        return titles.rlike("(?i)(?:^| )(?:" + "|".join(words) + r")\.?(?: |$)")

    gender = F.when(titled(FEMALE), "f").when(titled(MALE), "m").otherwise("x")
    pieces = pieces_of(mention)
    name = F.array_join(pieces, " ")
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    # a family has one surname where surnames have no gender
    of_family = F.when(script == "latin", "any").otherwise(gender)

    def part(piece: Column, i: Column) -> Column:
        last = i == F.size(pieces) - 1
        of = F.concat_ws(":", F.when(last, "surname").otherwise("given"), F.when(last, of_family).otherwise(gender), script)
        return F.struct(i.alias("part"), F.when(~stays(piece), of).alias("kind"), F.lower(piece).alias("norm"))

    names = F.filter(F.transform(pieces, part), lambda p: p["kind"].isNotNull())
    norm = (
        F.when(kind == "email", F.lower(mention))
        .when(kind == "ip", mention)
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .otherwise(digits(mention))
    )
    alone = F.array(F.struct(F.lit(0).alias("part"), kind.alias("kind"), norm.alias("norm")))
    return F.when(kind == "name", names).otherwise(alone)


def byte_at(digest: Column, i: Column) -> Column:
    """Byte ``i`` (from 0, around the end) of a hexadecimal digest."""
    return F.conv(F.substr(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def same_shape(value: Column, digest: Column) -> Column:
    """Letters for letters and digits for digits, other characters as they are."""

    def other(c: Column, i: Column) -> Column:
        v = byte_at(digest, i)
        letter = F.call_function("char", v % 26 + 97)
        return (
            F.when(c.rlike("^[0-9]$"), (v % 10).cast("string"))
            .when(c.rlike("^[a-z]$"), letter)
            .when(c.rlike("^[A-Z]$"), F.upper(letter))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), other), "")


def luhn(number: Column) -> Column:
    """Luhn sum modulo 10."""
    n = F.length(number)

    def step(total: Column, i: Column) -> Column:
        d = F.substr(number, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """What replaces an entity at its ``attempt``-th draw."""
    digest = F.sha2(F.concat_ws("\x01", F.lit(key), kind, norm, attempt.cast("string")), 512)
    # an e-mail's host depends on the host alone
    host = F.substring_index(norm, "@", -1)
    host_digest = F.sha2(F.concat_ws("\x01", F.lit(key), F.lit("host"), host), 512)
    top = F.substring_index(host, ".", -1)
    email = F.concat(
        same_shape(F.substring_index(norm, "@", 1), digest), F.lit("@"),
        same_shape(F.substring_index(host, ".", 1), host_digest),
        F.when(top.isin("com", "net", "org"), F.concat(F.lit(".example."), top)).otherwise(".example"),
    )
    octets = F.concat_ws(".", *((byte_at(digest, F.lit(i)) % 223 + 1).cast("string") for i in range(4)))
    drawn = same_shape(norm, digest)
    first = F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.substr(drawn, F.lit(2)))
    body = F.substr(first, F.lit(1), F.length(first) - 1)
    checked = F.concat(body, ((10 - luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))
    card = F.when(luhn(norm) == 0, checked).otherwise(first)
    # country code, then an area code that does not begin with 0 or 1
    code = F.greatest(F.length(norm) - 10, F.lit(0))
    phone = F.concat(
        F.substr(norm, F.lit(1), code), (byte_at(digest, F.lit(63)) % 8 + 2).cast("string"), F.substr(drawn, code + 2)
    )
    iban = F.concat(F.substr(norm, F.lit(1), F.lit(2)), F.substr(drawn, F.lit(3)))
    out = (
        F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "card", card)
        .when(kind == "phone", phone).when(kind == "iban", iban).when(kind == "ssn", F.concat(F.lit("9"), F.substr(drawn, F.lit(2))))
    )

    def pick(words: list[str], i: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), byte_at(digest, i) % len(words) + 1)

    def syllables(words: list[str]) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), attempt + 2), lambda i: pick(words, i)), "")

    for script, (starts, middles, given, surname) in SYLLABLES.items():
        middle = syllables(middles)
        for role, endings in (("given", given), ("surname", surname)):
            for gender, ending in endings.items():
                out = out.when(
                    kind == f"{role}:{gender}:{script}", F.lower(F.concat(pick(starts, F.lit(0)), middle, F.lit(ending)))
                )
    return out


def drawn_entities(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) of distinct entities, without collisions."""
    state = entities.withColumn("attempt", F.lit(0))
    for _ in range(ROUNDS):
        state = materialise(
            state.withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key)), "pii-drawn"
        )
        shared = state.groupBy("kind", "surrogate").agg(F.min("norm").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
        real = state.select(F.col("kind").alias("kind"), F.col("norm").alias("surrogate"), F.lit(True).alias("real"))
        state = materialise(
            state.join(shared, ["kind", "surrogate"], "left").join(real, ["kind", "surrogate"], "left").select(
                "kind", "norm", "attempt", "surrogate",
                (F.coalesce(F.col("owner") != F.col("norm"), F.lit(False)) | F.col("real").isNotNull()).alias("again"),
            ),
            "pii-checked",
        )
        if state.where("again").limit(1).count() == 0:
            return state.select("kind", "norm", "surrogate")
        state = state.select("kind", "norm", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    raise RuntimeError("surrogates still collide")


def refit(mention: Column, replacement: Column) -> Column:
    """Digits of a replacement in the mention's format."""

    def other(i: Column) -> Column:
        c = F.substr(mention, i, F.lit(1))
        nth = F.length(digits(F.substr(mention, F.lit(1), i)))
        return F.when(c.rlike("^[0-9]$"), F.substr(replacement, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), other), "")


def spaced(mention: Column, replacement: Column) -> Column:
    """An IBAN in the mention's groups."""

    def other(i: Column) -> Column:
        c = F.substr(mention, i, F.lit(1))
        nth = F.length(F.regexp_replace(F.substr(mention, F.lit(1), i), " ", ""))
        return F.when(c == " ", c).otherwise(F.substr(replacement, nth, F.lit(1)))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), other), "")


def rotated(key: str) -> tuple[str, str]:
    """Letters and what they become as initials."""
    digest = hashlib.sha256(f"{key}\x01initials".encode()).digest()
    turned = ""
    for n, letters in enumerate(ALPHABETS):
        by = 1 + digest[n] % (len(letters) - 1)
        turned += letters[by:] + letters[:by]
    return "".join(ALPHABETS), turned


def render(mention: Column, kind: Column, parts: Column, key: str) -> Column:
    """A mention with the surrogates of its parts, an array of (part, surrogate)."""
    only = F.get(parts, F.lit(0))["surrogate"]

    def cased(like: Column, name: Column) -> Column:
        return F.when(like == F.upper(like), F.upper(name)).otherwise(F.initcap(name))

    def piece(like: Column, i: Column) -> Column:
        made = F.get(F.filter(parts, lambda p: p["part"] == i), F.lit(0))["surrogate"]
        return (
            F.when(like.rlike(f"^{_INITIAL}$"), F.translate(like, *rotated(key)))
            .when(made.isNull(), like)
            .otherwise(cased(like, made))
        )

    titles = F.regexp_extract(mention, rf"^({_TITLES}) ", 1)
    name = F.array_join(F.transform(pieces_of(mention), piece), " ")
    return (
        F.when(kind == "email", F.when(mention == F.upper(mention), F.upper(only)).otherwise(only))
        .when(kind == "ip", only)
        .when(kind == "iban", spaced(mention, only))
        .when(kind == "name", F.concat(titles, F.lit(" "), name))
        .when(kind == "word", cased(mention, only))
        .otherwise(refit(mention, only))
    )


def replace(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """``doc_id``, ``text`` with surrogates, and ``n_entities`` of every row.

    ``key`` is the secret that makes replacements repeatable by its owner alone.
    """
    plain = documents(docs)
    holds = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(ENTITY), F.lit(False))
    named = F.col("text").rlike(NAME)

    def by_pattern(make) -> Column:
        return F.when(F.col("named"), make(WIDE)).otherwise(make(ENTITY))

    found = materialise(
        plain.where(holds).withColumn("named", named).select(
            "doc_id", "text", "named",
            F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), "text"), 256).alias("row"),
            by_pattern(lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("mentions"),
        ),
        "pii-found",
    )
    every = found.select("row", F.posexplode("mentions").alias("place", "mention")).withColumn(
        "of", kind_of(F.col("mention"))
    )
    keep = ("row", "place", "mention", "of", "part", "kind", "norm")
    mentions = (
        every.where("of <> 'word'")
        .select("row", "place", "mention", "of", F.explode(entities_of(F.col("mention"), F.col("of"))).alias("entity"))
        .select("row", "place", "mention", "of", "entity.part", "entity.kind", "entity.norm")
    )
    # untitled mentions: words that are a part of a name of the same text; a surname goes first
    known = mentions.where("of = 'name'").groupBy("row", "norm").agg(F.max("kind").alias("kind"))
    repeats = (
        every.where("of = 'word'")
        .withColumn("norm", F.lower("mention"))
        .join(known, ["row", "norm"])
        .withColumn("part", F.lit(0))
        .select(*keep)
    )
    # words that stay keep their place
    others = every.where("of = 'word'").select(
        "row", "place", "mention", "of", F.lit(None).cast("int").alias("part"), F.lit(None).cast("string").alias("surrogate")
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes but much work each: spread by a set number
    entities = mentions.select("kind", "norm").distinct().repartition(parts, "kind", "norm")
    names = drawn_entities(entities, key)
    written = (
        mentions.select(*keep).union(repeats)
        .join(names, ["kind", "norm"])
        .select("row", "place", "mention", "of", "part", "surrogate")
        .union(others)
        .repartition(parts, "row")
        .groupBy("row", "place")
        .agg(
            F.max("mention").alias("mention"),
            F.max("of").alias("of"),
            F.sort_array(
                F.collect_set(F.when(F.col("surrogate").isNotNull(), F.struct("part", "surrogate")))
            ).alias("parts"),
        )
        .withColumn("changed", F.size("parts") > 0)
        .withColumn(
            "out",
            F.when(F.col("changed"), render(F.col("mention"), F.col("of"), F.col("parts"), key)).otherwise(F.col("mention")),
        )
        # a text's own mentions; the text itself is as large
        .groupBy("row")
        .agg(
            F.sort_array(F.collect_list(F.struct("place", "out"))).alias("outs"),
            F.count_if("changed").alias("n_entities"),
        )
    )
    between = by_pattern(lambda p: F.split("text", F.lit(p), -1))
    text = F.array_join(
        F.transform(between, lambda s, i: F.concat(s, F.coalesce(F.get(F.col("outs"), i)["out"], F.lit("")))), ""
    )
    replaced = found.join(written, "row").select("doc_id", text.alias("text"), "n_entities")
    return plain.where(~holds).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities")).union(replaced)
