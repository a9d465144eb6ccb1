"""Personal data in texts: patterns propose, checksums confirm, nearby words adjust the score.

Column expressions only; nothing here runs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.textspans import Kind, clear, cut, let, pieces, proposals

# Fixed kinds of the contract, then those that the method adds; the order decides ties of starts.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "idnumber", "birthdate")
KINDS = BASE_KINDS + ADDED_KINDS

# Patterns of the contract. Runs are possessive, and an address or a number starts at the start of its run or where the
# match before ended: the same matches, but a run without one is walked once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# A part of an address that is 255 at most.
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

# Proposals of the method.
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
RUN = r"[A-Za-z0-9/.-]+"
RUNS = 99
SHAPES = {
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}[.]?$",
    "idnumber": r"^[A-Z]{0,2}[0-9]{6,10}[.]?$",
    "birthdate": r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})[.]?$",
}

# Points of a span by its kind, words near it that raise them, and words that lower them for every kind.
POINTS = {"email": 70, "ip": 50, "card": 70, "phone": 55, "iban": 75, "ssn": 30, "idnumber": 15, "birthdate": 20}
RAISE, LOWER, LEAST = 40, 25, 50
BEFORE, AFTER = 48, 24
NEAR = {
    "email": "e-?mail|mail to|contact|correo|courriel",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|mastercard|credit|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|telefon|telefono",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social security",
    "idnumber": "passport|licence number|license number|id number|tax id|personalausweis|pasaporte|passeport",
    "birthdate": "born|birth|dob|geboren|geburtsdatum|nacido|naissance",
}
AGAINST = "example|sample|test|version|invoice|order|isbn|article"


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def digit(value: Column, i: Column) -> Column:
    return F.ascii(F.substring(value, i + 1, F.lit(1))) - 48


def passes_luhn(digits: Column) -> Column:
    """Counted from the right, every second digit is doubled (less 9 above 9); the sum ends in 0."""

    def of(r: Column) -> Column:
        doubled = lambda i: digit(r, i) * 2 - F.when(digit(r, i) > 4, 9).otherwise(0)
        places = F.sequence(F.lit(0), F.length(r) - 1)
        return F.aggregate(places, F.lit(0), lambda s, i: s + F.when(i % 2 == 1, doubled(i)).otherwise(digit(r, i))) % 10 == 0

    return let(F.reverse(digits), of)


def passes_mod97(value: Column) -> Column:
    """The first four characters behind the others, letters as 10 to 35: the number leaves 1 when divided by 97."""

    def of(v: Column) -> Column:
        turned = F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))
        places = F.sequence(F.lit(1), F.length(v))
        code = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
        rest = F.aggregate(places, F.lit(0), lambda s, i: F.when(code(i) < 65, s * 10 + code(i) - 48).otherwise(s * 100 + code(i) - 55) % 97)
        return F.length(v).between(15, 34) & (rest == 1)

    return let(F.regexp_replace(value, "\\x20", ""), of)


def is_ip(found: Column) -> Column:
    return found.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")


def is_card(found: Column) -> Column:
    return let(only_digits(found), lambda d: F.when(F.length(d).between(14, 19), passes_luhn(d)).otherwise(False))


def is_phone(found: Column) -> Column:
    return F.length(only_digits(found)).between(10, 15)


def is_run(found: Column) -> Column:
    return F.length(found).between(6, 13) & found.rlike("^[A-Z]{0,2}[0-9]")


def contains_word(words: str, *windows: Column) -> Column:
    test = F.lit(False)
    for w in windows:
        test = test | w.rlike(f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)")
    return test


def lower_ascii(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def scored(spans: Column, text: Column) -> Column:
    """array<struct<start, kind, end, score, loose>>: points of each span; loose: a letter or digit stands right beside it."""

    def at(parts: Column, size: Column, x: Column) -> Column:
        near = F.struct(
            lower_ascii(cut(parts, F.greatest(x["start"] - BEFORE, F.lit(0)), x["start"])).alias("before"),
            lower_ascii(cut(parts, x["end"], F.least(x["end"] + AFTER, size))).alias("after"),
        )

        def points(n: Column) -> Column:
            own = F.lit(0)
            raised = F.lit(False)
            for i, kind in enumerate(KINDS):
                own = F.when(x["kind"] == i, POINTS[kind]).otherwise(own)
                raised = F.when(x["kind"] == i, contains_word(NEAR[kind], n["before"], n["after"])).otherwise(raised)
            score = own + F.when(raised, RAISE).otherwise(0) - F.when(contains_word(AGAINST, n["before"], n["after"]), LOWER).otherwise(0)
            beside = n["before"].rlike("[a-z0-9]$") | n["after"].rlike("^[a-z0-9]")
            return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.greatest(F.lit(0), F.least(F.lit(100), score)).alias("score"), beside.alias("loose"))

        return let(near, points)

    whole = F.struct(pieces(text).alias("parts"), F.length(text).alias("size"))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,score:int,loose:boolean>>)")
    return F.when(F.size(spans) > 0, let(whole, lambda w: F.transform(spans, lambda x: at(w["parts"], w["size"], x)))).otherwise(none)


def placed(x: Column) -> Column:
    """A proposal as struct<start, kind, end>; runs get the kind of their shape, a full stop at their end is no part of it."""
    kind = F.when(x["kind"] != RUNS, x["kind"])
    for name, shape in SHAPES.items():
        kind = F.when((x["kind"] == RUNS) & x["found"].rlike(shape), KINDS.index(name)).otherwise(kind)
    stop = F.when((x["kind"] == RUNS) & x["found"].endswith("."), 1).otherwise(0)
    return F.struct(x["start"].alias("start"), kind.alias("kind"), (x["end"] - stop).alias("end"))


def personal_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with ``found``: array<struct<start, kind, end, score>> in text order (kind: number in KINDS).

    Fixed kinds: leftmost matches per kind that pass their check, code points, end exclusive; they stay whatever their
    score. An added span needs ``least`` points and no letter or digit beside it; it overlaps no span of a fixed kind, and, account
    numbers excepted, nothing that may be an account number. Points run from 0 to 100: those of the kind, more if a word
    of the kind stands within 48 characters before or 24 behind, less if a word such as "example" does. Null and empty texts
    have none. A column ``found`` of the input is replaced; others stay.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    first, digits = len(BASE_KINDS), text.rlike("[0-9]")
    kinds = [
        Kind(0, EMAIL, hint=F.contains(text, F.lit("@"))),
        Kind(1, IP, is_ip, digits),
        Kind(2, CARD, is_card, digits),
        Kind(3, PHONE, is_phone, F.contains(text, F.lit("+"))),
        Kind(first, IBAN, passes_mod97, digits),
        Kind(RUNS, RUN, is_run, digits),
    ]
    rows = docs.drop("found").withColumn("found", F.transform(proposals(text, kinds), placed))
    # Fixed kinds precede account numbers, these the rest.
    level = lambda x: F.when(x["kind"] < first, 0).when(x["kind"] == first, 1).otherwise(2)
    rows = rows.withColumn("found", clear(F.filter("found", lambda x: x["kind"].isNotNull()), level, 3))
    rows = rows.withColumn("found", scored(F.col("found"), text))
    kept = F.filter("found", lambda x: (x["kind"] < first) | ((x["score"] >= least) & ~x["loose"]))
    return rows.withColumn("found", F.transform(kept, lambda x: x.dropFields("loose")))


def written(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores. See ``personal_spans``.

    ``scores`` are the points of ``spans``, in their order. Repeated rows and null ids give a row each.
    """
    rows = personal_spans(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"] < len(BASE_KINDS))
    return rows.select(
        "doc_id",
        *map(count, BASE_KINDS),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda x: x["score"].cast("string")), ",").alias("scores"),
    )
