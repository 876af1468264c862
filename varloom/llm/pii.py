"""Personal data replaced by surrogates, in built-in column functions only.

Entities are found by patterns. Each has a canonical form, so that other spellings of the same
e-mail, number or name are the same entity. A keyed SHA-256 stream of (kind, canonical form,
attempt) gives the surrogate, which keeps what the kind needs (check digits, country code,
gender, script) and is written in the shape of the text it stands for. All distinct entities
are then checked against each other and against the originals: of several with one surrogate
the first keeps it, the others get another attempt, until none collide.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import fresh
from varloom.plans.scale import cut_lineage

# fixed values: forms of address by the gender they show
MEN = "Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Sir", "г-н"
WOMEN = "Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "г-жа"
ANYONE = "Dr", "Prof", "Professor", "Professorin", "Doctor", "Doktor", "Docteur", "Mx", "Rev", "Hon", "д-р", "проф"
# fixed values: given names for surrogates, by gender and script
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Karl Leo Max Noah Otto Paul",
    ("f", "latin"): "Alma Bella Clara Diana Emma Frida Greta Helen Ida Julia Klara Lena Mia Nora",
    ("n", "latin"): "Alex Andrea Chris Eli Jo Kim Lou Nic Robin Sam Toni",
    ("n", "cyrillic"): "Валя Женя Саша Слава Шура",
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел",
    ("f", "cyrillic"): "Алла Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина",
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke la le lo ma me mo na ne no ra re ro sa se ta te to va",
    "cyrillic": "ба бе бо да де до фа фе га го ха хе ка ке ла ле ло ма ме мо на не но ра ре ро са се та те то ва",
}

ATTEMPTS = 100

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_WORD = r"\p{Lu}(?:[\p{L}-]|['’](?!s(?!\p{L}))){1,40}"
_TITLE = "(?:" + "|".join((*MEN, *WOMEN, *ANYONE)) + ")"
_TITLES = rf"{_TITLE}\.?(?: {_TITLE}\.?){{0,3}} "
_HEX = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])[0-9a-f]{32,64}(?![\p{L}\p{N}])",
    "apikey": r"(?<![\p{L}\p{N}_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,60}|sk-[A-Za-z0-9_-]{20,60})(?![\p{L}\p{N}_-])",
    "card": r"(?<![\d.])(?:\d{13,19}|\d{4}([ -])\d{4}\g\d{4}\g\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|{_HEX}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?|::{_HEX}(?::{_HEX}){{0,6}})(?![\p{{L}}\p{{N}}:]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)"
    # an international number after 00, a national one after 0, and ten digits of North America
    r"|(?<![\d.,+])00[1-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)"
    r"|(?<![\d.,+])(?:\(0[1-9]\d{1,4}\) ?|0[1-9]\d{1,4}[ ./-]?)\d{3,4}(?:[ .-]?\d{2,4}){1,2}(?!\d)"
    r"|(?<![\d.,+])(?:1[ .-])?[2-9]\d{2} ?\d{3} ?\d{4}(?![\d]|[.,]\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_TITLES}{_WORD}(?: {_WORD}){{0,2}}",
}
# one pattern for all; the only group inside is numbered from the left
ANY = "|".join(PATTERNS.values()).replace(r"\g", r"\1")
# what a text must hold to hold any of them
HINT = rf"[0-9@]|{_TITLE}\.? \p{{Lu}}"


def _full(kind: str) -> str:
    return f"^(?:{PATTERNS[kind]})$".replace(r"\g", r"\1")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string; a valid number has a multiple of ten."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            (d.cast("int") * 2).cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, d: a + d)


def kind_of(match: Column) -> Column:
    """Which kind a match is; NULL for numbers that fail their check digit."""
    card = match.rlike(_full("card"))
    out = F.when(card, F.when(luhn_sum(_digits(match)) % 10 == 0, "card"))
    out = out.when(match.contains("@"), "email")
    for kind in ("ip", "ipv6", "ssn", "secret", "apikey", "iban", "name"):
        out = out.when(match.rlike(_full(kind)), kind)
    return out.otherwise("phone")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _named(match: Column) -> Column:
    """The words of a name without its forms of address."""
    return F.split(F.regexp_replace(match, f"^{_TITLES}", ""), " ")


def _atoms(match: Column, kind: Column) -> Column:
    """The entities in a match: one, but for names, whose words are entities of their own."""
    words = _named(match)
    titles = F.regexp_extract(match, f"^{_TITLES}", 0)
    gender = F.lit("n")
    for mark, own in (("m", MEN), ("f", WOMEN)):
        gender = F.when(titles.rlike("(?:^| )(?:" + "|".join(own) + r")\.? "), mark).otherwise(gender)
    script = F.when(match.rlike(r" \p{IsCyrillic}"), "cyrillic").otherwise("latin")
    given = F.concat(F.lit("given-"), gender, F.lit("-"), script)
    family = F.concat(F.lit("family-"), script)

    def atom(kind, canon):
        return F.struct(kind.alias("kind"), canon.alias("canon"))

    names = F.transform(
        words, lambda w, i: atom(F.when(i + 1 < F.size(words), given).otherwise(family), F.lower(w))
    )
    group = F.split(F.lower(match), "::", -1)
    left, right = (
        F.filter(F.split(F.coalesce(F.get(group, F.lit(i)), F.lit("")), ":"), lambda g: g != "") for i in (0, 1)
    )
    gap = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))
    ipv6 = F.array_join(F.transform(F.concat(left, gap, right), lambda g: F.lpad(g, 4, "0")), "")
    number = _digits(match)
    canon = (
        F.when(kind.isin("card", "ssn"), number)
        .when(kind == "phone", F.when(F.length(number) > 10, F.right(number, F.lit(10))).otherwise(number))
        .when(kind == "iban", F.regexp_replace(match, " ", ""))
        .when(kind == "email", F.lower(match))
        .when(kind == "ipv6", ipv6)
        .otherwise(match)
    )
    return F.when(kind == "name", names).when(kind.isNotNull(), F.array(atom(kind, canon)))


def _drawn(hexadecimal: Column, i: Column) -> Column:
    """The i-th number from 0 to 255 of a stream."""
    return F.conv(F.substring(hexadecimal, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, number: Column, width: int = 1) -> Column:
    place = number % (len(letters) // width) * width + 1
    return F.substring(F.lit(letters), place.cast("int"), F.lit(width))


def _shape(shape: Column, stream: Column, hexadecimal: Column) -> Column:
    """Digits for digits, letters for letters of the same case, other characters kept."""

    def one(c: Column, i: Column) -> Column:
        return _let(
            _drawn(stream, i),
            lambda n: F.when(hexadecimal, _pick("0123456789abcdef", n))
            .when(c.rlike("[0-9]"), _pick("0123456789", n))
            .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
            .when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", n))
            .otherwise(c),
        )

    return F.array_join(F.transform(F.split(shape, ""), one), "")


def surrogate(secret: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The canonical form of an entity's surrogate."""
    seed = F.concat_ws("|", F.lit(secret), kind, canon, attempt.cast("string"))
    stream = _let(
        seed, lambda s: F.concat(*[F.sha2(F.concat(s, F.lit(f"|{i}")), 256) for i in range(4)])
    )
    entity = F.struct(
        kind.alias("kind"), canon.alias("canon"), attempt.alias("attempt"), stream.alias("stream")
    )

    def prepared(e: Column) -> Column:
        numbers = F.transform(
            F.sequence(F.lit(0), F.length(e["canon"]) - 1),
            lambda i: _pick("0123456789", _drawn(e["stream"], i)),
        )
        shape = F.when(e["kind"] == "email", F.substring_index(e["canon"], "@", 1)).otherwise(e["canon"])
        return F.struct(
            e["kind"].alias("kind"),
            e["canon"].alias("canon"),
            e["attempt"].alias("attempt"),
            e["stream"].alias("stream"),
            F.array_join(numbers, "").alias("numbers"),
            _shape(shape, e["stream"], e["kind"] == "secret").alias("shaped"),
        )

    return _let(entity, lambda e: _let(prepared(e), lambda p: _formed(secret, p)))


def _formed(secret: str, p: Column) -> Column:
    kind, canon, stream, numbers, shaped = (
        p[c] for c in ("kind", "canon", "stream", "numbers", "shaped")
    )
    size = F.length(canon)

    def at(i: int) -> Column:
        return _drawn(stream, F.lit(i))

    card = _let(
        F.concat(F.left(canon, F.lit(1)), F.substring(numbers, F.lit(2), size - 2)),
        lambda body: F.concat(
            body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
        ),
    )
    home = F.sha2(F.concat_ws("|", F.lit(secret), F.substring_index(canon, "@", -1)), 256)
    octets = [(at(0) % 223 + 1).cast("string"), *[at(i).cast("string") for i in (1, 2, 3)]]
    out = (
        F.when(kind == "card", card)
        .when(
            kind == "email",
            F.concat(shaped, F.lit("@d"), F.left(home, F.lit(8)), F.lit(".example.net")),
        )
        .when(kind == "ip", F.concat_ws(".", *octets))
        .when(kind == "ipv6", F.concat(F.lit("20010db8"), F.substring(stream, 1, 24)))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(numbers, F.lit(2), F.lit(8))))
        .when(
            kind == "phone",
            F.concat(_pick("23456789", at(100)), F.substring(numbers, F.lit(2), size)),
        )
        .when(kind == "iban", F.concat(F.left(canon, F.lit(2)), F.substring(shaped, F.lit(3), size)))
        .when(kind == "apikey", F.concat(F.left(canon, F.lit(4)), F.substring(shaped, F.lit(5), size)))
    )
    for script, letters in SYLLABLES.items():
        spelled = [_pick(letters.replace(" ", ""), at(i), 2) for i in range(5)]
        out = out.when(kind == f"family-{script}", F.concat(*spelled[:4]))
        for gender, end in (("m", "n"), ("f", "na"), ("n", "r")):
            names = GIVEN[gender, script].lower()
            name = F.get(F.split(F.lit(names), " "), at(0) % len(names.split()))
            # after the listed names, made ones that end as the gender's do
            end = end if script == "latin" else end.translate({ord("n"): "н", ord("a"): "а", ord("r"): "р"})
            more = F.concat(*spelled[1:], F.lit(end))
            out = out.when(
                kind == f"given-{gender}-{script}", F.when(p["attempt"] < 4, name).otherwise(more)
            )
    return out.otherwise(shaped)


def _refilled(shape: Column, pattern: Column, letters: Column) -> Column:
    """The shape with its characters of a pattern replaced by the letters in turn."""
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))

    def step(acc: Column, c: Column) -> Column:
        own = F.rlike(c, pattern)
        return F.struct(
            F.concat(
                acc["text"], F.when(own, F.substring(letters, acc["next"], F.lit(1))).otherwise(c)
            ).alias("text"),
            (acc["next"] + F.when(own, 1).otherwise(0)).alias("next"),
        )

    return F.aggregate(F.split(shape, ""), start, step, lambda acc: acc["text"])


def _cased(words: Column, names: Column) -> Column:
    """Names in the case of the words they stand for."""
    return F.zip_with(
        words, names, lambda w, n: F.when(w == F.upper(w), F.upper(n)).otherwise(F.initcap(n))
    )


def _written(match: Column, kind: Column, forms: Column) -> Column:
    """The canonical surrogates of a match in the shape of its text."""

    first = forms[0]
    number = _digits(match)
    country = F.greatest(F.length(number) - F.length(first), F.lit(0))
    letters = F.when(kind == "phone", F.concat(F.left(number, country), first)).otherwise(first)
    pattern = F.when(kind == "iban", "[A-Z0-9]").otherwise("[0-9]")
    named = F.concat(
        F.regexp_extract(match, f"^{_TITLES}", 0), F.array_join(_cased(_named(match), forms), " ")
    )
    return (
        F.when(kind.isin("card", "ssn", "phone", "iban"), _refilled(match, pattern, letters))
        .when(kind == "name", named)
        .when(kind == "ipv6", F.regexp_replace(first, "(.{4})(?=.)", "$1:"))
        .otherwise(first)
    )


def _mentions(match: Column, forms: Column) -> Column:
    """What else in a text stands for a name: all of its words, and each of them."""

    def mention(words: Column, names: Column) -> Column:
        return F.struct(F.array_join(words, " ").alias("form"), names.alias("names"))

    words = _named(match)
    each = F.zip_with(words, forms, lambda w, f: mention(F.array(w), F.array(f)))
    return F.concat(F.array(mention(words, forms)), each)


def _any_of(known: Column) -> Column:
    """A pattern of the mentions as written, capitalised, and in capitals; the longest first."""
    own = F.transform(known, lambda k: k["form"])
    ways = F.array_distinct(F.concat(own, F.transform(own, F.initcap), F.transform(own, F.upper)))
    longest = F.array_sort(ways, lambda x, y: F.length(y) - F.length(x))
    inside = F.array_join(longest, "|")
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), inside, F.lit(r")(?![\p{L}\p{N}])"))


def _mentioned(text: Column, known: Column, pattern: Column) -> Column:
    """A text with the mentions of known names replaced."""

    def new(found: Column) -> Column:
        same = F.filter(known, lambda k: F.lower(k["form"]) == F.lower(found))
        return F.array_join(_cased(F.split(found, " "), F.get(same, F.lit(0))["names"]), " ")

    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), new)
    parts = F.split(text, pattern, -1)
    joined = F.zip_with(parts, found, lambda p, f: F.concat(p, F.coalesce(f, F.lit(""))))
    return F.array_join(joined, "")


def _matches(text: Column) -> Column:
    """All matches of a text, each with its kind."""
    hint = F.coalesce(text.rlike(HINT), F.lit(False))
    found = F.when(hint, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    return F.transform(found, lambda m: F.struct(m.alias("match"), kind_of(m).alias("kind")))


def entities(df: DataFrame, *, text: str = "text") -> DataFrame:
    """(kind, canon): the distinct entities of all texts."""
    found = df.select(F.explode(_matches(F.col(text))).alias("m")).where("m.kind IS NOT NULL")
    atoms = found.select(F.explode(_atoms(F.col("m.match"), F.col("m.kind"))).alias("a"))
    return atoms.select("a.kind", "a.canon").distinct()


def settle(found: DataFrame, secret: str) -> DataFrame:
    """(kind, canon, attempt, surrogate) with distinct surrogates that are no originals.

    ``found`` holds distinct entities. Surrogates settled earlier stay as they are. Entities
    too short to have enough surrogates of their shape raise after ``ATTEMPTS`` rounds.
    """
    form = surrogate(secret, F.col("kind"), F.col("canon"), F.col("attempt"))
    originals = found.select("kind", F.col("canon").alias("surrogate"))
    pending, settled = found.withColumn("attempt", F.lit(0)), None
    for _ in range(ATTEMPTS):
        tried = cut_lineage(pending.withColumn("surrogate", form))
        free = tried.join(originals, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled, ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(
            F.min("canon").alias("canon"), F.min("attempt").alias("attempt")
        )
        won = cut_lineage(won.select("kind", "canon", "attempt", "surrogate"))
        settled = won if settled is None else settled.union(won)
        lost = tried.join(won, ["kind", "canon"], "left_anti")
        pending = cut_lineage(
            lost.select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        )
        if pending.isEmpty():
            return settled
    raise RuntimeError(f"entities still share surrogates after {ATTEMPTS} attempts")


def replace_private(df: DataFrame, *, secret: str, text: str = "text") -> DataFrame:
    """The table with private data in ``text`` replaced; all other columns stay.

    Kinds: e-mail, IBAN, long hexadecimal secrets, API keys, payment cards with a right check
    digit, IPv4 and IPv6 addresses, US social security numbers, phone numbers, and names after a
    form of address, with all later and earlier mentions of their words in the same text that
    begin with a capital. Names that have no form of address in their text are not found. IPv6
    addresses are written in full. One entity has the same surrogate everywhere, two never share one, and none is
    the original of another. Other text is unchanged to the letter. NULL stays NULL, empty
    stays empty, repeated rows stay, an empty table gives an empty one.
    """
    settled = settle(cut_lineage(entities(df, text=text)), secret)
    retried = cut_lineage(settled.where("attempt > 0").select("kind", "canon", "attempt"))
    matches, mark, again, done, known, pattern = fresh(
        df, "_matches", "_mark", "_again", "_done", "_known", "_pattern"
    )
    source = F.col(text)
    out = df.withColumn(matches, _matches(source))
    none = retried.isEmpty()
    if not none:  # by text, the entities in it that needed another attempt
        atoms = F.explode(F.flatten(F.transform(matches, lambda m: _atoms(m["match"], m["kind"]))))
        own = out.select(F.xxhash64(source).alias(mark), atoms.alias("a"))
        own = own.select(mark, "a.kind", "a.canon").distinct().join(retried, ["kind", "canon"])
        entry = F.struct(F.concat_ws("|", "kind", "canon"), "attempt")
        by_text = own.groupBy(mark).agg(F.map_from_entries(F.collect_list(entry)).alias(again))
        out = out.withColumn(mark, F.xxhash64(source)).join(by_text, mark, "left")

    def attempt(a: Column) -> Column:
        if none:
            return F.lit(0)
        tried = F.try_element_at(F.col(again), F.concat_ws("|", a["kind"], a["canon"]))
        return F.coalesce(tried, F.lit(0))

    def written(m: Column) -> Column:
        forms = F.transform(
            _atoms(m["match"], m["kind"]),
            lambda a: surrogate(secret, a["kind"], a["canon"], attempt(a)),
        )
        new = _let(
            F.struct(m["match"].alias("match"), m["kind"].alias("kind"), forms.alias("forms")),
            lambda x: F.struct(
                _written(x["match"], x["kind"], x["forms"]).alias("text"),
                F.when(x["kind"] == "name", _mentions(x["match"], x["forms"])).alias("mentions"),
            ),
        )
        return F.when(m["kind"].isNotNull(), new).otherwise(
            F.struct(m["match"].alias("text"), F.lit(None).alias("mentions"))
        )

    out = out.withColumn(done, F.transform(matches, written))
    named = F.filter(F.transform(done, lambda d: d["mentions"]), lambda x: x.isNotNull())
    out = out.withColumn(known, F.flatten(named))
    out = out.withColumn(pattern, F.when(F.size(known) > 0, _any_of(F.col(known))))
    pieces = F.split(source, ANY, -1)
    pieces = F.when(
        F.col(pattern).isNotNull(),
        F.transform(pieces, lambda p: _mentioned(p, F.col(known), F.col(pattern))),
    ).otherwise(pieces)
    replaced = F.zip_with(
        pieces,
        F.transform(done, lambda d: d["text"]),
        lambda p, m: F.array(p, F.coalesce(m, F.lit(""))),
    )
    changed = F.when(F.size(matches) > 0, F.array_join(F.flatten(replaced), "")).otherwise(source)
    return out.withColumn(text, changed).select(df.columns)
