"""Personal data replaced by surrogates, with DataFrame functions only.

Mentions are found by one pattern. Each entity (a kind and a normal form) gets one surrogate, drawn
from a keyed digest: of the same kind, shape, script and gender. Draws that meet another entity's
surrogate, or any real entity of the corpus, are drawn again until all are distinct. So
different entities stay different, and every mention of one entity, in whatever notation, gets
the same surrogate in its own notation. Domains of addresses are entities too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.operators.skew import fixed, join_unique
from qaloom.session import cut

#: What may stand between the groups of a phone number: a few characters, none of them a letter or digit.
_GAP = r"[^\p{L}\p{N}\n]{1,8}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLE = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Señora": "f", "Госпожа": "f",
    "Dr": "", "Prof": "", "Doctor": "", "Professor": "", "Mx": "", "Доктор": "", "Профессор": "",
}
#: Words that may stand between the names of a person; they stay.
PARTICLES = "da de dei del della den der di do dos du la las le los ten ter van von vom y zu zum zur al bin ibn".split()
#: Given names by script and gender, and surnames by script: known names, and those that surrogates are drawn from.
GIVEN = {
    ("latin", "m"): "John Michael David Thomas Robert Daniel Peter Stefan Jürgen Pierre Antoine Carlos Javier Miguel",
    ("latin", "f"): "Maria Elizabeth Jennifer Susan Julia Katharina Ingrid Camille Isabelle Carmen Lucía Sophie Emily Hannah",
    ("cyrillic", "m"): "Александр Дмитрий Сергей Андрей Михаил Николай Владимир Павел",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана",
}
SURNAMES = {
    "latin": "Miller Carter Walker Bennett Fischer Schneider Hoffmann Lambert Moreau Garnier Navarro Castillo Romero Vidal",
    "cyrillic": "Кузнецов Соколов Лебедев Новиков Морозов Волков Зайцев Павлов",
}
SYLLABLES = {"latin": "ba do fe ki lo ma ne ri so tu va wen", "cyrillic": "ба до ве ки ло ма не ри со ту ва ян"}
#: Letters without case are drawn from common ones of their script; those of other scripts become Latin.
UNCASED = [
    ("人大中上下山水火木金土日月天心手口目耳足", r"\p{IsHan}"), ("あいうえおかきくけこさしすせそたちつてと", r"\p{IsHiragana}"),
    ("アイウエオカキクケコサシスセソタチツテト", r"[\p{IsKatakana}ー]"), ("가나다라마바사아자차카타파하거너더러머버", r"\p{IsHangul}"),
    ("ابتثجحخدذرزسشصضطعغفقكلمنهوي", r"\p{IsArabic}"), ("אבגדהוזחטיכלמנסעפצקרשת", r"\p{IsHebrew}"),
    ("กขคงจฉชซดตถทนบปผพฟมยรลวสหอ", r"\p{IsThai}"), ("कखगघचछजझटठडढतथदधनपफबभमयरलवशसह", r"\p{IsDevanagari}"),
]
_LETTERS = r"\p{Lu}(?:\p{L}|['’](?!s?(?!\p{L})))++"
_NAME = rf"{_LETTERS}(?:-{_LETTERS}){{0,3}}+"
_TITLES = rf"(?:(?:{'|'.join(_TITLE)})\.? )"
#: Further names of a mention, with initials and particles between them; the runs are possessive, so they take no stack.
_NEXT = rf"(?:(?:\p{{Lu}}\.|{'|'.join(PARTICLES)}) )*+(?!(?:{'|'.join(_TITLE)})(?![\p{{L}}\p{{N}}])){_NAME}"
_GIVEN_ALL = "|".join(sorted({n for names in GIVEN.values() for n in names.split()}))

#: Names that are also words of dates: where they stand alone they are taken for the word.
DATE_WORDS = "January March April May June July August Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()

_OPEN, _CLOSE = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: The patterns of mentions, grouped by what must stand in front, so that most places of a text are passed over by one look.
#: Runs are possessive or start at a boundary: no word is read more than once for a pattern.
#: A value that repeats one sign, as in "********", is masked already and no mention.
_AFTER_QUOTE = (
    r"(?<=[\"'])(?<=(?i:token|secret|password|passwd|key)[^\p{L}\p{N}\n]{0,8}[=:][^\p{L}\p{N}\n]{0,8}[\"'])"
    r"(?!([^\p{L}\p{N}\s\"'])\1*+[\"'])[^\"'\s]{8,}+(?=[\"'])"
)
_AT_WORD = [
    r"(?<![._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){1,126}",
    rf"[0-9a-fA-F]{{32,}}+{_CLOSE}", rf"(?:AKIA|ASIA)[A-Z0-9]{{16}}{_CLOSE}", r"(?:ghp|gho|sk|pk)_[A-Za-z0-9]{16,}+",
    rf"(?<!:)(?:[0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}(?![\p{{L}}\p{{N}}:])",
    rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_CLOSE}",
    rf"(?=\p{{Lu}})(?:{_TITLES}++{_NEXT}(?: {_NEXT})*+|(?:{_GIVEN_ALL})(?: {_NEXT})++)",
]
_AT_NUMBER = [
    rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    rf"\+\d{{1,3}}{_GAP}\d{{2,4}}{_GAP}\d{{2,4}}(?:{_GAP}\d{{2,4}}){{0,2}}(?!\d)|\+\d{{9,15}}(?!\d)",
    r"\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)|(?<![.-])\d{3}-\d{4}(?![\d-])",
    r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])",
    # Card numbers: unbroken, in groups of four, or any other groups that do not run into an unbroken one.
    r"\d{13,19}(?!\d)", r"\d{4}(?: \d{4}){3}(?: \d{1,3}(?!\.?\d))?(?!\d)|\d{4}(?:-\d{4}){3}(?:-\d{1,3}(?!\.?\d))?(?!\d)",
    r"(?!(?:\d{1,9}[ -]){1,6}\d{13})\d(?:[ -]?\d){12,18}(?!\.?\d)",
]
PATTERN = rf"{_OPEN}(?=[\p{{L}}\p{{N}}._%+-])(?:{'|'.join(_AT_WORD)})|(?<!\d)(?=[\d(+])(?:{'|'.join(_AT_NUMBER)})|{_AFTER_QUOTE}"
PERSON = rf"^(?:{_TITLES}|(?:{_GIVEN_ALL}) )"
DIGIT_KINDS = ("phone", "ssn", "card")
#: Parts of mentions that are no entities: they stay, but for initials.
PLAIN = ("initial", "particle", "number")
#: Entities a task draws for, while the session's number of shuffle partitions allows it.
ENTITIES_A_TASK = 2000
#: Draws within an entity's own form; each one after that is from a wider form, so every entity gets a surrogate however full its form is.
ROUNDS = 16


def _kind(mention: Column) -> Column:
    """The kind of a mention, by its form alone.

    A run of digits that is not in groups of four is a card only if its check digit holds, else a number, which stays.
    """
    whole = {
        "email": r"^[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+$",
        "ipv6": r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$",
        "ip": rf"^(?:{_OCTET}\.){{3}}{_OCTET}$",
        "ssn": r"^\d{3}-\d{2}-\d{4}$",
        "phone": r"^(?:\+\d[\d\W_]*|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}|\d{3}-\d{4})$",
        "card": r"^\d(?:[ -]?\d){12,18}$",
        "iban": r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$",
        "person": PERSON,
    }
    out = F.when(mention.rlike(r"^[0-9a-fA-F]{32,}$"), F.lit("secret"))
    checked = mention.rlike(r"^\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?!\d)") | (_luhn(F.regexp_replace(mention, r"\D", "")) == 0)
    for kind, pattern in whole.items():
        named = F.when(checked, F.lit("card")).otherwise(F.lit("number")) if kind == "card" else F.lit(kind)
        out = out.when(mention.rlike(pattern), named)
    return out.otherwise(F.lit("secret"))


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))


def _gender(mention: Column, given: Column) -> Column:
    """By the title, else by a known given name, else by the ending of the given name."""
    title = F.regexp_extract(mention, rf"^({'|'.join(_TITLE)})\.? ", 1)
    out = F.when(title.isin([t for t, g in _TITLE.items() if g == "m"]), "m")
    out = out.when(title.isin([t for t, g in _TITLE.items() if g == "f"]), "f")
    for (_, gender), names in GIVEN.items():
        out = out.when(given.isin(names.split()), gender)
    return out.when(given.rlike("[aаяe]$"), "f").otherwise("m")


def _persons(mentions: Column) -> Column:
    """The persons mentioned, without titles."""
    return F.transform(F.filter(mentions, lambda m: m.rlike(PERSON)), lambda m: F.regexp_replace(m, rf"^{_TITLES}+", ""))


def _surnames(persons: Column) -> Column:
    """The last names of persons; a given name alone is none."""
    return F.array_distinct(F.transform(F.filter(persons, lambda m: ~m.isin(_GIVEN_ALL.split("|"))), lambda m: F.substring_index(m, " ", -1)))


def _names(persons: Column) -> Column:
    """All names of persons that may also stand alone, longer ones first."""
    names = F.filter(
        F.array_distinct(F.flatten(F.transform(persons, lambda m: F.split(m, " ")))), lambda m: m.rlike(rf"^{_NAME}$") & ~m.isin(DATE_WORDS))
    ordered = F.array_sort(F.transform(names, lambda m: F.struct((-F.length(m)).alias("size"), m.alias("name"))))
    return F.transform(ordered, lambda m: m["name"])


def _with_bare(names: Column) -> Column:
    """The pattern of mentions, and of these names where they stand alone."""
    return F.concat(F.lit(PATTERN + rf"|{_OPEN}(?=\p{{Lu}})(?:"), F.array_join(names, "|"), F.lit(f"){_CLOSE}"))


def _named(mentions: DataFrame) -> DataFrame:
    """Add what all parts of a mention share, once for each mention: its words, whether it has a title, its gender (of a lone name only if known)."""
    mention = F.col("mention")
    tokens = F.split(F.regexp_replace(mention, rf"^{_TITLES}+", ""), " ")
    given = F.get(F.filter(F.col("tokens"), lambda t: ~t.rlike(r"^\p{Lu}\.$") & ~t.isin(*PARTICLES)), F.lit(0))
    split = fixed(mentions.withColumn("tokens", F.when(F.col("of") == "person", tokens)), "tokens")
    whole = split.withColumn("titled", mention.rlike(rf"^{_TITLES}")).withColumn("last", F.size("tokens") - 1)
    told = F.col("titled") | (F.col("last") > 0) | given.isin(_GIVEN_ALL.split("|"))
    return fixed(whole.withColumn("whose", F.when(told, _gender(mention, given))), "titled", "whose", "last")


def _parts(mention: Column, kind: Column) -> Column:
    """The entities of a mention of ``_named``: for a person one for each name, initial and particle, the last one the surname."""
    none = F.lit(None).cast("string")

    def part(token: Column, i: Column) -> Column:
        alone = (F.col("last") == 0) & F.when(F.col("titled"), token.isin(_GIVEN_ALL.split("|"))).otherwise(~F.array_contains("surnames", token))
        name = (
            F.when(token.rlike(r"^\p{Lu}\.$"), F.lit("initial")).when(token.isin(*PARTICLES), F.lit("particle"))
            .when((i == F.col("last")) & ~alone, F.lit("surname")).otherwise(F.lit("given"))
        )
        return F.struct(
            name.alias("kind"), token.alias("norm"), F.when(name == "given", F.col("whose")).alias("gender"),
            _script(token).alias("script"))

    norm = (
        F.when(kind.isin(*DIGIT_KINDS), F.regexp_replace(mention, r"\D", ""))
        .when(kind.isin("email", "ipv6"), F.lower(mention))
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .otherwise(mention)
    )
    single = F.array(F.struct(kind.alias("kind"), norm.alias("norm"), none.alias("gender"), _script(norm).alias("script")))
    return F.when(kind == "person", F.transform("tokens", part)).otherwise(single)


def _draw(key: str, what: Column, size: Column) -> Column:
    """A list of at least ``size`` keyed numbers from 0 to 65535 for ``what``."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(size / 32).cast("int")), lambda i: F.sha2(F.concat_ws("\x1f", F.lit(key), what, i.cast("string")), 512)
    )
    stream = F.array_join(blocks, "")
    return F.transform(
        F.sequence(F.lit(0), size.cast("int") - 1), lambda i: F.conv(F.substring(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
    )


def _letters(text: Column, drawn: Column, hexadecimal: Column) -> Column:
    """Each letter and digit replaced by a drawn one of its kind and script; other characters stay.

    A text without letters and digits has no such form; each of its characters becomes a letter.
    """
    alphabets = [
        ("0123456789", r"[0-9]"), ("abcdefghijklmnopqrstuvwxyz", r"[\p{Ll}&&\P{IsCyrillic}]"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[\p{Lu}&&\P{IsCyrillic}]"),
        ("абвгдежзиклмнопрстуфхцчшэюя", r"[\p{Ll}&&\p{IsCyrillic}]"), ("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", r"[\p{Lu}&&\p{IsCyrillic}]"),
    ]
    latin = alphabets[1][0]

    def pick(alphabet: str, n: Column) -> Column:
        return F.substring(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))

    def one(c: Column, i: Column) -> Column:
        n = F.get(drawn, i)
        out = F.when(hexadecimal & c.rlike("[0-9a-f]") & ~text.rlike("[A-F]"), F.substring(F.lit("0123456789abcdef"), n % 16 + 1, F.lit(1)))
        out = out.when(hexadecimal & c.rlike("[0-9A-F]") & ~text.rlike("[a-f]"), F.substring(F.lit("0123456789ABCDEF"), n % 16 + 1, F.lit(1)))
        for alphabet, pattern in alphabets:
            out = out.when(c.rlike(pattern), pick(alphabet, n))
        out = out.when(~c.rlike(r"[\p{L}\p{N}]"), F.when(text.rlike(r"[\p{L}\p{N}]") | (c == ""), c).otherwise(pick(latin, n)))
        for alphabet, pattern in UNCASED:
            out = out.when(c.rlike(r"\p{L}") & c.rlike(pattern), pick(alphabet, n))
        return out.when(c.rlike(r"\p{N}"), pick(alphabets[0][0], n)).otherwise(pick(latin, n))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn remainder of a string of digits."""
    def add(total: Column, pair: Column) -> Column:
        doubled = pair["d"] * 2
        return total + F.when(pair["i"] % 2 == 0, pair["d"]).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    listed = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(listed, F.lit(0), add) % 10


def _pick(words: str, n: Column) -> Column:
    listed = words.split()
    return F.get(F.array(*map(F.lit, listed)), n % len(listed))


def _surrogate(key: str) -> Column:
    """The surrogate of an entity (kind, norm, gender, script, domain) at its ``attempt``.

    From attempt ``ROUNDS`` on the form is wider: one more symbol at each attempt; for addresses the
    private block 10.0.0.0/8 (or any public first octet), and at last unique local IPv6 addresses.
    """
    kind, norm, attempt = F.col("kind"), F.col("norm"), F.col("attempt")
    what = F.concat_ws("\x1f", kind, norm, attempt.cast("string"))
    base = F.greatest(F.length(norm), F.lit(8))
    wider = F.greatest(attempt - ROUNDS + 1, F.lit(0))
    drawn = _draw(key, what, base + wider)
    added = F.slice(drawn, base + 1, wider)
    digits = F.array_join(F.transform(added, lambda n: (n % 10).cast("string")), "")
    letters = F.array_join(F.transform(added, lambda n: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), n % 26 + 1, F.lit(1))), "")
    hexadecimal = norm.rlike(r"^[0-9a-fA-F:]+$") & kind.isin("secret", "ipv6")
    shaped = _letters(norm, drawn, hexadecimal)
    # A domain is an entity of its own, so that addresses of one domain stay together; its last label stays.
    top = F.substring_index(norm, ".", -1)
    host = F.substring(norm, F.lit(1), F.length(norm) - F.length(top) - 1)
    domain = F.concat(_letters(host, drawn, F.lit(False)), letters, F.lit("."), top)
    email = F.concat(_letters(F.substring_index(norm, "@", 1), drawn, F.lit(False)), letters, F.lit("@"), F.col("domain"))
    octets = F.split(norm, r"\.")
    first = F.get(octets, F.lit(0)).cast("int")
    ip = F.concat_ws(
        ".", F.when(first.isin(10, 127, 172, 192), first).otherwise(F.get(drawn, F.lit(0)) % 40 + 128).cast("string"),
        F.when(first.isin(172, 192), F.get(octets, F.lit(1))).otherwise((F.get(drawn, F.lit(1)) % 254 + 1).cast("string")),
        (F.get(drawn, F.lit(2)) % 254 + 1).cast("string"), (F.get(drawn, F.lit(3)) % 254 + 1).cast("string"),
    )
    public = F.get(drawn, F.lit(0)) % 222 + 1
    block = F.when(first.isin(10, 127, 172, 192), F.lit(10)).otherwise(public + (public >= 10).cast("int"))
    ip_wider = F.concat_ws(".", block.cast("string"), *[(F.get(drawn, F.lit(k)) % 254 + 1).cast("string") for k in (1, 2, 3)])
    local_v6 = F.concat(F.lit("fd"), F.substring(F.array_join(F.transform(
        F.slice(drawn, 1, 8), lambda n: F.concat(F.lit(":"), F.lower(F.lpad(F.hex(n), 4, "0")))), ""), 4, 99))
    ip = F.when(attempt < ROUNDS, ip).when(attempt < ROUNDS + 8, ip_wider).otherwise(local_v6)
    # The first digit (network, country) and the check remainder of a card stay.
    body = F.concat(F.substring(norm, 1, 1), F.substring(shaped, F.lit(2), F.length(norm) - 2), digits)
    last = (_luhn(norm) - _luhn(F.concat(body, F.lit("0"))) + 10) % 10
    card = F.concat(body, last.cast("string"))
    # A phone number first gives up its first digit, and then its length.
    phone = F.concat(F.substring(F.when(attempt < ROUNDS, norm).otherwise(shaped), 1, 1), F.substring(shaped, F.lit(2), F.length(norm)),
                     F.when(attempt >= ROUNDS + 8, digits).otherwise(""))
    iban = F.concat(F.substring(norm, 1, 2), F.substring(shaped, F.lit(3), F.length(norm)), digits)
    ipv6 = F.when(attempt < ROUNDS, shaped).otherwise(local_v6)
    shaped = F.concat(shaped, F.when(hexadecimal | (kind == "ssn"), digits).otherwise(letters))
    one = F.get(drawn, F.lit(0))
    given = F.lit(None).cast("string")
    for (script, gender), names in GIVEN.items():
        given = F.when((F.col("script") == script) & (F.col("gender") == gender), _pick(names, one)).otherwise(given)
    surname, more = F.lit(None).cast("string"), F.lit(None).cast("string")
    for script in SURNAMES:
        same = F.col("script") == script
        surname = F.when(same, _pick(SURNAMES[script], one)).otherwise(surname)
        # Past the list, names grow by drawn syllables in front of their ending.
        grown = F.array_join(F.transform(
            F.slice(drawn, 2, F.least(F.floor(attempt / 2).cast("int"), F.lit(6)) + wider), lambda n: _pick(SYLLABLES[script], n)), "")
        more = F.when(same, grown).otherwise(more)
    female = F.col("gender") == "f"
    end = F.when(F.col("script") == "cyrillic", F.when(female, "на").otherwise("ан")).otherwise(F.when(female, "na").otherwise("on"))
    given = F.when(attempt < 2, given).otherwise(F.concat(F.initcap(more), end))
    surname = F.when(attempt < 2, surname).otherwise(F.concat(surname, more))
    return (
        F.when(kind == "email", email).when(kind == "domain", domain).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "card", card)
        .when(kind == "phone", phone).when(kind == "iban", iban)
        .when(kind == "given", given).when(kind == "surname", surname).otherwise(shaped)
    )


def _initial(norm: Column, key: str) -> Column:
    """Another initial of the same script: no entity, as there are few and many share one."""
    n = F.get(_draw(key, F.concat_ws("\x1f", F.lit("initial"), norm), F.lit(8)), F.lit(0))
    latin, cyrillic = ([F.lit(f"{c}.") for c in letters] for letters in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"))
    letters = F.array_remove(F.when(_script(norm) == "cyrillic", F.array(*cyrillic)).otherwise(F.array(*latin)), norm)
    return F.get(letters, n % F.size(letters))


def _form(text: str) -> Column:
    """What two surrogates must differ in: the letters without their case, as a digest of fixed size."""
    return F.sha2(F.lower(text), 256)


def _distinct(entities: DataFrame, surrogate: Column) -> DataFrame:
    """(kind, norm, surrogate): one distinct surrogate, by the column that draws, for each entity (kind, norm, gender, script, domain).

    In a round all entities without a surrogate draw one. A form that is no real entity's and was not taken in an
    earlier round goes to the first that drew it; the others draw again, and only they move. Forms and winners have one
    row each before they are joined, so no join has a hot key. The form grows with the draws past ``ROUNDS``, so this
    ends for any number of entities.
    """
    spark, held = entities.sparkSession, cut(entities.withColumn("attempt", F.lit(0)))
    waiting, n, settled = held, held.count(), []
    while n or not settled:
        tasks = min(1 + n // ENTITIES_A_TASK, int(spark.conf.get("spark.sql.shuffle.partitions")))
        # The number of the draw is a column, so that all rounds run the same compiled code.
        tried = cut(waiting.repartition(tasks, "kind", "norm").withColumn("surrogate", surrogate)).withColumn("form", _form("surrogate"))
        firsts = tried.groupBy("form").agg(F.min(F.struct("kind", "norm", "surrogate")).alias("who"))
        taken = reduce(DataFrame.unionByName, [won.select("form") for won in settled], held.select(_form("norm").alias("form")))
        met = taken.join(firsts.select("form"), "form", "left_semi").distinct()
        settled.append(cut(firsts.join(met, "form", "left_anti").select("form", "who.*")))
        waiting = tried.join(settled[-1].select("kind", "norm"), ["kind", "norm"], "left_anti").select(
            *[c for c in held.columns if c != "attempt"], (F.col("attempt") + 1).alias("attempt"))
        n -= settled[-1].count()
    return reduce(DataFrame.unionByName, settled).select("kind", "norm", "surrogate")


def draw_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate): one distinct surrogate for each entity (kind, norm, gender, script).

    The domains of addresses are drawn first, distinct from each other and from all real domains.
    """
    none, surrogate = F.lit(None).cast("string"), _surrogate(key)
    others = entities.where("kind <> 'email'").withColumn("domain", none)
    addresses = entities.where("kind = 'email'").withColumn("domain", F.substring_index("norm", "@", -1))
    domains = addresses.select("domain").distinct().select(
        F.lit("domain").alias("kind"), F.col("domain").alias("norm"), none.alias("gender"), none.alias("script"), none.alias("domain"))
    drawn = _distinct(domains, surrogate).select(F.col("norm").alias("domain"), F.col("surrogate").alias("drawn"))
    placed = join_unique(addresses, drawn, ["domain"]).withColumn("domain", F.col("drawn")).drop("drawn")
    return _distinct(others.unionByName(placed), surrogate)


def _rendered(mention: Column, kind: Column, drawn: Column) -> Column:
    """Surrogates written in the notation of a mention: its separators, title and letter case; what is longer follows."""
    only = F.get(drawn, F.lit(0))

    def beyond(separators: str) -> Column:
        return F.substring(only, F.length(F.regexp_replace(mention, separators, "")) + 1, F.length(only))

    digits = F.array_join(F.transform(
        F.split(mention, ""),
        lambda c, i: F.when(c.rlike(r"\d"), F.substring(
            only, F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), r"\D", "")), F.lit(1))).otherwise(c),
    ), "")
    blanks = F.array_join(F.transform(
        F.split(mention, ""),
        lambda c, i: F.when(c != " ", F.substring(
            only, F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), " ", "")), F.lit(1))).otherwise(c),
    ), "")
    letters = F.split(mention, "")
    cased = F.array_join(F.transform(
        F.split(only, ""), lambda c, i: F.when(F.get(letters, i).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    title = F.regexp_extract(mention, rf"^({_TITLES}+)", 1)
    return (
        F.when(kind.isin(*DIGIT_KINDS), F.concat(digits, beyond(r"\D"))).when(kind == "iban", F.concat(blanks, beyond(" "))).when(kind.isin("email", "ipv6"), cased)
        .when(kind == "person", F.concat(title, F.array_join(drawn, " "))).otherwise(only)
    )


def replace_entities(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with every entity in the text replaced; with ``count``, a column with their number.

    Null and empty texts stay as they are, and so do all other columns, whatever their types and names, and repeated
    rows. An empty table stays empty. The same key gives the same surrogates for the same set of entities.
    """
    names, at = docs.columns, docs.columns.index(text)
    # Names with dots would be read as fields of structs.
    own = [f"c{k}" for k in range(len(names))]
    body = F.col("row")[own[at]]
    listed = fixed(docs.toDF(*own).select(
        F.struct(*own).alias("row"),
        F.coalesce(F.regexp_extract_all(F.col(own[at]), F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>")).alias("mentions"),
    ), "mentions")
    # A name that a text gives with a title or given name is also a mention where it stands alone in that text.
    persons = fixed(listed.withColumn("persons", _persons(F.col("mentions"))), "persons")
    known = fixed(persons.withColumn("surnames", _surnames(F.col("persons"))).withColumn("names", _names(F.col("persons"))).drop("persons"), "surnames", "names")
    marked = cut(known.withColumn("mentions", F.when(
        F.size("names") > 0, F.regexp_extract_all(body, _with_bare(F.col("names")), F.lit(0))).otherwise(F.col("mentions"))))
    hit = marked.where(F.size("mentions") > 0).withColumn("digest", F.sha2(body, 256))
    # A text that stands in several rows is looked at once.
    texts = hit.select("digest", "mentions", "surnames", "names").dropDuplicates(["digest"])
    alone = F.col("mention").rlike(rf"^{_NAME}$") & F.array_contains("names", F.col("mention"))
    mentions = texts.select("digest", "surnames", "names", F.posexplode("mentions").alias("pos", "mention")).select(
        "digest", "pos", "mention", "surnames", F.when(alone, F.lit("person")).otherwise(_kind(F.col("mention"))).alias("of"))
    parts = cut(_named(mentions).select(
        "digest", "pos", "mention", "of", F.posexplode(_parts(F.col("mention"), F.col("of"))).alias("part", "entity")
    ).select("digest", "pos", "mention", "of", "part", "entity.*"))
    entities = parts.where(~F.col("kind").isin(*PLAIN)).groupBy("kind", "norm").agg(F.min("gender").alias("gender"), F.min("script").alias("script"))
    drawn = draw_surrogates(entities, key)
    placed = join_unique(parts, drawn, ["kind", "norm"]).withColumn("surrogate", F.when(F.col("kind") == "initial", _initial(F.col("norm"), key))
        .otherwise(F.coalesce("surrogate", "norm")))
    # All groups below are of one text, so no larger than it.
    each = placed.groupBy("digest", "pos", "mention", "of").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("part", "surrogate"))), lambda s: s["surrogate"]).alias("drawn")
    ).select("digest", "pos", "of", _rendered(F.col("mention"), F.col("of"), F.col("drawn")).alias("new"))
    rendered = each.groupBy("digest").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda s: s["new"]).alias("news"),
        F.count_if(F.col("of") != "number").cast("int").alias("n"),
    )
    between = F.when(F.size("names") > 0, F.split(body, _with_bare(F.col("names")), -1)).otherwise(F.split(body, PATTERN, -1))
    rebuilt = F.array_join(F.zip_with(between, F.col("news"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    replaced = join_unique(hit, rendered, ["digest"], "inner").select("row", rebuilt.alias("text"), "n")
    plain = marked.where(F.size("mentions") == 0).select("row", body.alias("text"), F.lit(0).alias("n"))
    columns = [F.col("text" if k == at else f"row.{c}").alias(names[k]) for k, c in enumerate(own)]
    return plain.unionByName(replaced).select(*columns, *([F.col("n").alias(count)] if count else []))
