"""Personal data: entities are found by patterns and get keyed surrogates of their own kind, in SQL expressions only.

A surrogate depends on the key and on the entity's normal form alone, so one person, number or address has one
surrogate in all documents, however it is written. It keeps the format: letters stay letters of their case,
digits digits, punctuation stays, cards keep their first digit and a valid check digit, IP addresses stay valid,
first names keep gender (their own, or else their title's) and script, surnames their script, IPv6 addresses their zeros
and how they are written. A surname that stands alone in a text which has it in a person's name follows that person. Distinct entities are checked: where two have one
surrogate, or a surrogate is someone's real value, those entities get another try until none are left.

What is grouped are the distinct entities, reduced in each task first. Documents are not shuffled unless more than
LITERAL entities need another attempt than the first, whose documents then get their attempts by a join.

Defined results: null and empty texts stay as they are; repeated rows get the same result; other columns stay;
an empty table gives no rows. A column named like an output (n_entities) is replaced.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import free_names, stage

# Frequent given names by gender and script, and titles that tell a gender.
NAMES = {
    ("m", "latin"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Andrew Kenneth Joshua Kevin Brian George Carlos Miguel Pierre Stefan Liam Noah Oliver Lucas Henry Benjamin Alexander Samuel Jack Peter Paul Mark Simon Martin Frank Hans Klaus Jürgen Wolfgang Luis Juan José Jorge Pablo Diego Jean Jacques Luc Antoine Ahmed Omar Raj Arjun Wei".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Emily Michelle Amanda Melissa Deborah Stephanie Maria Carmen Sophie Ursula Olivia Emma Ava Isabella Mia Charlotte Amelia Grace Hannah Laura Julia Anna Eva Helen Alice Claire Rachel Rebecca Nicole Ingrid Petra Sabine Monika Lucía Ana Isabel Pilar Marie Camille Chloé Nathalie Fatima Aisha Priya Ananya Mei".split(),
    ("m", "cyrillic"): "Александр Дмитрий Сергей Андрей Алексей Максим Иван Михаил Николай Владимир".split(),
    ("f", "cyrillic"): "Елена Ольга Наталья Анна Татьяна Ирина Мария Светлана Екатерина Юлия".split(),
}
TITLES = {"m": "Mr Herr Señor Monsieur Господин".split(), "f": "Mrs Ms Miss Frau Señora Madame Mme Госпожа".split(), "": "Dr Prof".split()}
_SYLLABLES = {
    "latin": "bar bel cor dan der fal gar hol kem lan lor mar mor nel pas ren rod sal sten tal tor vel wen win".split(),
    "cyrillic": "бар бел вор дан дел зар кор лен лов мар нор пав рен род сал сев тар тол фед шин".split(),
}
_ENDS = {"latin": "son ley man ford ard ell".split(), "cyrillic": "ский ченко енко ич ук".split()}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_GIVEN = "|".join(n for ns in NAMES.values() for n in ns)
_SURNAME = r"\p{Lu}[\p{L}'’-]+"
_PAIR = rf"{_SURNAME} (?:\p{{Lu}}\. )?{_SURNAME}"
# two capitalised words are a person where a label or a closing line is before them, or a mail address or number in brackets behind
_LABEL = r"(?:(?:[Nn]ame|NAME|[Cc]ontact|[Pp]atient|[Cc]lient|[Cc]ustomer|[Ee]mployee|[Ss]igned|[Aa]uthor): ?|[Mm]y name is |(?:[Rr]egards|[Ss]incerely),\s)"
_PERSON = rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{_TITLE})\.? {_SURNAME}(?: {_SURNAME})?|(?:{_GIVEN}) (?:\p{{Lu}}\. )?{_SURNAME}|(?<={_LABEL}){_PAIR}|{_PAIR}(?= ?[(<][A-Za-z0-9._%+-]{{1,64}}@| ?[(<](?:\+|tel|Tel|phone|Phone)))"
_SECRET_NAME = r"(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|passwd|pwd|[Aa]pi[_ -]?[Kk]ey|API[_ -]?KEY|access_key)"
PATTERN = "|".join(
    (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
        rf"(?<![A-Za-z])(?=[TtSsPpAa]){_SECRET_NAME}\s{{0,2}}[=:]\s{{0,2}}[\"']?(?=[A-Za-z_+/-]*\d)[A-Za-z0-9_+/-]{{8,}}",
        r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,})",
        r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
        r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])",
        r"(?<![\w:])(?=[0-9A-Fa-f:]{0,40}\d)(?=(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:]))(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}(?![\w:])",
        r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
        r"(?<!\d)(?:(?:\d{4}[ -]?){3}\d{1,7}|\d{4}[ -]?\d{6}[ -]?\d{5})(?!\d)",
        r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)",
        r"(?<![\w.])(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?!\d)",
        r"(?<![\w.+:/-])0\d{2,4}(?: ?[-/] ?| )\d{5,8}(?![\w:-])",
        r"(?<![\w.+:/-])(?=(?:[ /-]?\d){9,12}(?![\w:]|[ -]\d))0\d{1,4}(?:[ /-]\d{2,4}){2,4}(?![\w:-])",
        _PERSON,
    )
)
_MAYBE = rf"[@0-9]|{_PERSON}"
_VALUE = r"[A-Za-z0-9_+/-]+$"


def _let(value: Column, f) -> Column:
    """f(value) with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def kind(e: Column) -> Column:
    """email, ip, ipv6, ssn, secret, iban, card, phone or person."""
    return (
        F.when(e.rlike(rf"^{_SECRET_NAME}\s*[=:]"), "secret")
        .when(e.contains("@"), "email")
        .when(e.rlike(r"^(AKIA|gh[pousr]_|sk-)"), "secret")
        .when(e.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(e.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f]*:[0-9A-Fa-f:]*$"), "ipv6")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]+$"), "iban")
        .when(e.rlike(r"^[\d -]+$") & (F.length(_digits(e)) >= 13), "card")
        .when(e.rlike(r"^[+(\d]"), "phone")
        .otherwise("person")
    )


def _groups(e: Column, far: bool = False) -> Column:
    """The written groups of an IPv6 address before '::' (all where there is none), or ``far`` the ones behind."""
    part = F.try_element_at(F.split(e, "::", -1), F.lit(2 if far else 1))
    return F.when(F.coalesce(part, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(part, ":", -1))


def _full_address(e: Column) -> Column:
    """All eight groups of an IPv6 address, in lower case with four digits each."""

    def made(x: Column) -> Column:
        zeros = F.array_repeat(F.lit("0000"), 8 - F.size(x["a"]) - F.size(x["b"]))
        pad = lambda g: F.transform(g, lambda c: F.lpad(F.lower(c), 4, "0"))
        return F.array_join(F.concat(pad(x["a"]), zeros, pad(x["b"])), ":")

    return _let(F.struct(_groups(e).alias("a"), _groups(e, True).alias("b")), made)


def _address(e: Column, full: Column, noise: Column) -> Column:
    """Another address with zeros where ``full`` has them, written as ``e`` is."""

    def one(g: Column, i: Column) -> Column:
        return F.when(g == "0000", g).otherwise(F.concat(F.substr(F.lit("123456789abcdef"), _number(noise, i, 15) + 1, F.lit(1)), F.substr(noise, (i * 4 + 60).cast("int"), F.lit(3))))

    def written(new: Column) -> Column:
        def part(groups: Column, ahead: Column) -> Column:
            return F.array_join(F.transform(groups, lambda g, i: F.when(F.length(g) == 4, F.element_at(new, ahead + i + 1)).otherwise(F.regexp_replace(F.element_at(new, ahead + i + 1), "^0{1,3}", ""))), ":")

        return F.concat(part(_groups(e), F.lit(0)), F.when(F.contains(e, F.lit("::")), F.lit("::")).otherwise(F.lit("")), part(_groups(e, True), 8 - F.size(_groups(e, True))))

    return _let(F.transform(F.split(full, ":"), one), written)


def _normal(e: Column, k: Column) -> Column:
    return (
        F.when(k == "email", F.lower(e))
        .when(k == "ipv6", _full_address(e))
        .when(k.isin("ssn", "card", "phone"), _digits(e))
        .when(k == "iban", F.replace(e, F.lit(" "), F.lit("")))
        .when(k == "secret", F.regexp_extract(e, _VALUE, 0))
        .when(k == "person", F.regexp_replace(e, rf"^(?:{_TITLE})\.? ", ""))
        .otherwise(e)
    )


def normal(e: Column) -> Column:
    """What entities that mean the same have in common."""
    return _let(kind(e), lambda k: _normal(e, k))


def _last_word(e: Column) -> Column:
    return F.element_at(F.split(e, " "), -1)


def _number(noise: Column, i: Column, below: int) -> Column:
    """The i-th number below ``below`` of the noise (128 hex digits), i from 0."""
    return F.conv(F.substr(noise, (F.pmod(i, F.lit(63)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int") % below


def _alike(e: Column, noise: Column) -> Column:
    """``e`` with each letter and digit replaced by one of its class."""
    pick = lambda chars, i: F.substr(F.lit(chars), _number(noise, i, len(chars)) + 1, F.lit(1))
    lows, ups = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def made(hexes: Column) -> Column:
        one = lambda c, i: F.when(c.rlike("[0-9a-f]") & hexes, pick("0123456789abcdef", i)).when(c.rlike("[0-9]"), pick("0123456789", i)).when(c.rlike("[a-z]"), pick(lows, i)).when(c.rlike("[A-Z]"), pick(ups, i)).otherwise(c)
        return F.array_join(F.transform(F.split(e, ""), one), "")

    return _let(e.rlike(r"^[0-9a-f]{8,}$") & e.rlike("[a-f]"), made)


def _fill(e: Column, digits: Column) -> Column:
    """``e`` with its digits replaced in order by ``digits``."""

    def made(d: Column) -> Column:
        nth = lambda i: F.length(_digits(F.substr(e, F.lit(1), i + 1)))
        return F.array_join(F.transform(F.split(e, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(d, nth(i), F.lit(1))).otherwise(c)), "")

    return _let(digits, made)


def _luhn_sum(digits: Column) -> Column:
    """Of digits from the right, the second and every other doubled."""
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x)


def _some_digits(noise: Column, first: int, last: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(first), last), lambda i: _number(noise, i, 10).cast("string")), "")


def _card(e: Column, d: Column, noise: Column) -> Column:
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), _some_digits(noise, 1, F.length(d) - 2))
    whole = lambda b: F.concat(b, F.pmod(10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    return _fill(e, _let(body, whole))


def _plain(e: Column, d: Column, noise: Column, keep: int = 0) -> Column:
    """Digits replaced in order; the first ``keep`` stay."""
    return _fill(e, F.concat(F.substr(d, F.lit(1), F.lit(keep)), _some_digits(noise, keep, F.length(d) - 1)))


def _invented(word: Column, noise: Column, attempt: Column) -> Column:
    """A surname with a syllable more for each attempt, so that there are always more of them than names."""

    def made(script: str) -> Column:
        s, ends = (F.array(*map(F.lit, x[script])) for x in (_SYLLABLES, _ENDS))
        part = lambda i: F.element_at(s, _number(noise, F.lit(i), len(_SYLLABLES[script])) + 1)
        more = F.array_join(F.transform(F.slice(F.sequence(F.lit(3), attempt + 4), 2, attempt), lambda i: F.element_at(s, _number(noise, i, len(_SYLLABLES[script])) + 1)), "")
        return F.initcap(F.concat(part(0), part(1), part(2), more, F.element_at(ends, _number(noise, F.lit(3), len(_ENDS[script])) + 1)))

    return F.when(word.rlike(r"^\p{IsCyrillic}"), made("cyrillic")).otherwise(made("latin"))


def _given(word: Column, key: str) -> Column:
    """Another given name of its gender and script: each list is put in a keyed order, and a name stands for the one before it, so none coincide."""
    tables = []
    for names in NAMES.values():
        order = sorted(names, key=lambda n: hmac.new(key.encode(), n.encode(), hashlib.sha256).digest())
        table = F.create_map(*[F.lit(x) for i, n in enumerate(order) for x in (n, order[i - 1])])
        tables.append(F.try_element_at(table, word))
    return F.coalesce(*tables)


def _contradicts(e: Column, word: Column) -> Column:
    """Whether a person's title tells another gender than the given name's list."""
    title = F.regexp_extract(e, rf"^(?:({_TITLE})\.? )?", 1)
    of = lambda gender: [n for (g, _), names in NAMES.items() if g == gender for n in names]
    return (title.isin(*TITLES["m"]) & word.isin(*of("f"))) | (title.isin(*TITLES["f"]) & word.isin(*of("m")))


def _titled(e: Column, word: Column, noise: Column, attempt: Column) -> Column:
    """A given name of the gender that a person's title tells, two of them at the next attempt; null without a title or later."""
    title = F.regexp_extract(e, rf"^(?:({_TITLE})\.? )?", 1)
    script = F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    found = []
    for (gender, of), names in NAMES.items():
        table = F.array(*map(F.lit, names))
        one = lambda i, table=table, names=names: F.element_at(table, _number(noise, F.lit(i), len(names)) + 1)
        pick = F.when(attempt == 0, one(0)).when(attempt == 1, F.concat(one(0), F.lit("-"), one(1)))
        found.append(F.when(title.isin(*TITLES[gender]) & (script == of), pick))
    return F.coalesce(*found)


def surrogates(entities: Column, key: str, attempt) -> Column:
    """The replacements of an array of entities; null for one that turns out to be none (a number that fails the card check).

    attempt: gives an entity's attempt from its root, which is its normal form, and for persons the surname.
    Each step adds a field, so that no expression is repeated.
    """
    a = F.transform(entities, lambda e: F.struct(e.alias("e"), kind(e).alias("k")))
    a = F.transform(a, lambda x: F.struct(x.e.alias("e"), x.k.alias("k"), _normal(x.e, x.k).alias("n")))
    a = F.transform(a, lambda x: F.struct(x.e.alias("e"), x.k.alias("k"), x.n.alias("n"), F.when(x.k == "person", _last_word(x.n)).otherwise(x.n).alias("root")))
    second = lambda x: F.when(x.k == "email", F.regexp_extract(x.n, "@(.+)$", 1)).when(x.k == "person", F.when(F.contains(x.n, F.lit(" ")), F.split(x.n, " ")[0]))
    a = F.transform(a, lambda x: F.struct(x.e.alias("e"), x.k.alias("k"), x.n.alias("n"), x.root.alias("root"), second(x).alias("other"), attempt(x.root).cast("string").alias("t")))
    # a given name outside the list changes with its surname's attempt, as two may have one surrogate
    later = lambda x: [F.when((x.k == "person") & (x.t != "0"), x.t)]
    noise = lambda *parts: F.sha2(F.concat_ws("|", F.lit(key), *parts), 512)
    a = F.transform(a, lambda x: F.struct(x.e.alias("e"), x.k.alias("k"), x.n.alias("n"), x.root.alias("root"), x.other.alias("other"), x.t.cast("int").alias("t"), noise(x.k, x.t, x.root).alias("z"), noise(x.k, F.lit("other"), *later(x), x.other).alias("y")))

    def made(x: Column) -> Column:
        e, k, n, z = x.e, x.k, x.n, x.z
        email = F.concat(_alike(F.regexp_extract(e, "^([^@]+)@", 1), z), F.lit("@"), _alike(F.regexp_extract(x.other, r"^(.+)\.[^.]+$", 1), x.y), F.regexp_extract(x.other, r"\.[^.]+$", 0))
        head = F.coalesce(F.nullif(F.regexp_extract(e, rf"^{_SECRET_NAME}\s*[=:]\s*[\"']?", 0), F.lit("")), F.regexp_extract(e, r"^(?:AKIA|gh[pousr]_|sk-)", 0))
        title = F.regexp_extract(e, rf"^(?:(?:{_TITLE})\.? )?", 0)
        first = F.concat(F.coalesce(F.when(~_contradicts(e, x.other), _given(x.other, key)), _titled(e, x.other, x.y, x.t), _invented(x.other, x.y, x.t)), F.lit(" "))
        return (
            F.when(k == "email", email)
            .when(k == "secret", _let(head, lambda h: F.concat(h, _alike(F.substr(e, F.length(h) + 1), z))))
            .when(k == "ip", F.concat_ws(".", *[(_number(z, F.lit(i), 254) + 1).cast("string") for i in range(4)]))
            .when(k == "ipv6", _address(e, n, z))
            .when(k == "ssn", _plain(e, n, z))
            .when(k == "iban", F.concat(F.substr(e, F.lit(1), F.lit(2)), _alike(F.substr(e, F.lit(3)), z)))
            .when(k == "card", F.when(_luhn_sum(n) % 10 == 0, _card(e, n, z)))
            .when(k == "phone", _plain(e, n, z, 1))
            .otherwise(F.concat(title, F.when(x.other.isNotNull(), first).otherwise(F.lit("")), _invented(x.root, z, x.t)))
        )

    return F.transform(a, made)


def _root(e: Column) -> Column:
    return _let(kind(e), lambda k: F.when(k == "person", _last_word(_normal(e, k))).otherwise(_normal(e, k)))


def _attempts(found: DataFrame, key: str, most: int = 50) -> DataFrame:
    """(root, attempt) of the entities that need another attempt than 0. found: distinct entities."""
    at = stage(found.select("entity", _root(F.col("entity")).alias("root"), normal(F.col("entity")).alias("norm"), F.lit(0).alias("attempt")), "entities")
    for _ in range(most):
        made = F.element_at(surrogates(F.array("entity"), key, lambda _: F.col("attempt")), 1)
        made = at.withColumn("new", made).filter("new IS NOT NULL").select("entity", "root", "norm", "new", normal(F.col("new")).alias("made"))
        # surnames alone must differ too, as they may stand without a given name
        alone = made.filter(kind(F.col("entity")) == "person").select("root", F.col("root").alias("norm"), _last_word(F.col("made")).alias("made"))
        made = stage(made.select("root", "norm", "made").unionByName(alone).distinct(), "made")
        # of several that have one surrogate the smallest stays as it is
        clash = made.groupBy("made").agg(F.min("norm").alias("stays"), F.max("norm").alias("other")).filter("stays != other").select("made", "stays")
        real = at.select(F.explode(F.array("norm", "root")).alias("made")).distinct()
        again = made.join(clash, "made").filter("norm != stays").select("root").unionByName(made.join(real, "made", "left_semi").select("root")).distinct()
        again = stage(again.withColumnRenamed("root", "_r"), "again")
        if not again.limit(1).count():
            return at.filter("attempt > 0").select("root", "attempt").distinct()
        at = stage(at.join(again, F.col("root") == F.col("_r"), "left").withColumn("attempt", F.col("attempt") + F.when(F.col("_r").isNotNull(), 1).otherwise(0)).drop("_r"), "entities")
    raise RuntimeError("surrogates still collide")


def _surnames(entities: Column, new: Column) -> Column:
    """(old, new) of the surnames of three letters or more among a text's entities, each once."""
    named = lambda e, s: F.when((kind(e) == "person") & s.isNotNull(), F.struct(_last_word(e).alias("old"), _last_word(s).alias("new")))
    pairs = F.filter(F.zip_with(entities, new, named), lambda x: x.isNotNull() & (F.length(x["old"]) >= 3))
    return F.coalesce(F.array_distinct(pairs), F.array().cast("array<struct<old:string,new:string>>"))


#: At most so many entities with another attempt than 0 become a literal; beyond, their documents are joined to them.
LITERAL = 2000


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the entities in ``text`` replaced by surrogates that ``key`` alone decides, and their number."""
    _m, _s, _a, _row, _b = free_names(docs, "m", "s", "a", "row", "b")
    body = F.col(text)
    matches = F.when(body.rlike(_MAYBE), F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0)))
    found = docs.select(F.explode(matches).alias("entity")).distinct()
    attempts = stage(_attempts(stage(found, "found"), key), "attempts")
    some = attempts.limit(LITERAL + 1).count()
    docs = docs.withColumn(_m, matches)
    if some == 0:
        attempt_of = lambda root: F.lit(0)
    elif some <= LITERAL:
        table = F.create_map(*[F.lit(x) for r in attempts.collect() for x in (r["root"], r["attempt"])])
        attempt_of = lambda root: F.coalesce(F.try_element_at(table, root), F.lit(0))
    else:
        docs = stage(docs.withColumn(_row, F.monotonically_increasing_id()), "rows")
        roots = docs.select(_row, F.explode(F.array_distinct(F.transform(_m, _root))).alias("root"))
        maps = roots.join(attempts, "root").groupBy(_row).agg(F.map_from_entries(F.collect_list(F.struct("root", "attempt"))).alias(_a))
        docs = docs.join(maps, _row, "left").drop(_row)
        attempt_of = lambda root: F.coalesce(F.try_element_at(F.col(_a), root), F.lit(0))
    docs = docs.withColumn(_s, surrogates(F.col(_m), key, attempt_of))
    docs = docs.withColumn(_b, _surnames(F.col(_m), F.col(_s)))
    new = F.zip_with(_m, _s, lambda e, s: F.coalesce(s, e))
    alone = lambda x: F.concat(F.lit(r"(?<![\p{L}\p{N}@._'’-])"), x["old"], F.lit(r"(?![\p{L}\p{N}@_-])"))
    followed = lambda p: F.aggregate(_b, p, lambda now, x: F.regexp_replace(now, alone(x), x["new"]))
    joined = F.array_join(F.zip_with(F.split(body, PATTERN, -1), new, lambda p, s: F.concat(followed(p), F.coalesce(s, F.lit("")))), "")
    bare = F.aggregate(F.split(body, PATTERN, -1), F.lit(0), lambda n, p: n + F.aggregate(_b, F.lit(0), lambda k, x: k + F.regexp_count(p, alone(x))))
    bare = F.when(F.size(_b) > 0, bare).otherwise(0)
    out = docs.withColumn("n_entities", F.coalesce(F.size(F.filter(_s, lambda s: s.isNotNull())) + bare, F.lit(0)).cast("long"))
    return out.withColumn(text, F.when(F.size(_m) > 0, joined).otherwise(body)).drop(_m, _s, _a, _b)
