r"""Personal data in texts, in DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for payment
cards, modulus 97 for account numbers, modulus 11 and weighted digits for
other ids, plain rules for addresses and dates), and the words beside a span
adjust its score.

The base kinds (email, ip, card, phone) keep every span that their pattern and
validator pass; the other kinds need a score of `THRESHOLD`, which most of them
reach only beside a word that names them.

A pattern's matches and the text between them come from the text in two
passes; the ends are running sums of the lengths of both, taken in blocks of
`BLOCK` matches, so that time follows the text however many matches it holds.
Patterns begin only where a run of their characters begins and repeat
possessively: they never rescan a run and never recurse by its length.

A span's context is up to `BEFORE` code points in front of it and `AFTER`
behind it, as far as the neighbouring matches of the same pattern.

Defined results: a null text counts as empty and has no spans; spans are
half-open, in code points, by kind as listed and then by start; spans of
different kinds may overlap; repeated rows repeat; an empty table gives an
empty one.  `digest` leaves other columns behind, `with_spans` keeps all.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
BEFORE, AFTER = 48, 24
BLOCK = 512
NEAR, AGAINST = 0.3, -0.25

#: Lengths of account numbers by country (ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _each(text: Column, value: Callable[[Column, Column], Column]) -> Column:
    """Sum of `value(character, place)` over a short text, places from 1."""
    places = F.sequence(F.lit(1), F.length(text))
    return F.aggregate(F.transform(places, lambda i: value(F.substring(text, i, F.lit(1)), i)), F.lit(0), lambda a, v: a + v)


def luhn(m: Column) -> Column:
    """Every second digit from the right doubled: the digit sum ends in 0."""
    def digit(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return _each(F.reverse(_digits(m)), digit) % 10 == 0


def mod97(m: Column) -> Column:
    """The first four characters behind the others, letters as 10 to 35: the
    number leaves 1 when divided by 97."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    values = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(turned, i, F.lit(1))) - 1)
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def mod11(m: Column) -> Column:
    """Ten digits weighted 10 to 1: the sum is divisible by 11."""
    return _each(_digits(m), lambda c, i: c.cast("int") * (F.lit(11) - i)) % 11 == 0


def weighted371(m: Column) -> Column:
    """Nine digits weighted 3, 7, 1 in turn: the sum is divisible by 10."""
    weight = lambda i: F.when(i % 3 == 1, 3).when(i % 3 == 2, 7).otherwise(1)
    return _each(_digits(m), lambda c, i: c.cast("int") * weight(i)) % 10 == 0


def octets(m: Column) -> Column:
    return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")


def day_of_birth(m: Column) -> Column:
    """A real calendar day from 1900 on, year first or last."""
    n = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    first = F.length(F.get(n, F.lit(0))) == 4
    y, d = F.when(first, F.get(n, F.lit(0))).otherwise(F.get(n, F.lit(2))), F.when(first, F.get(n, F.lit(2))).otherwise(F.get(n, F.lit(0)))
    day = lambda a, b: F.try_to_date(F.concat_ws("-", y, F.lpad(a, 2, "0"), F.lpad(b, 2, "0")), "yyyy-MM-dd")
    mid = F.get(n, F.lit(1))
    return F.coalesce(day(mid, d), F.when(~first, day(d, mid))) >= F.lit("1900-01-01").cast("date")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float  # of what the pattern proposes
    words: str  # that speak for the kind
    confirm: Callable[[Column], Column] | None = None
    confirmed: float = 0.0  # what the validator adds
    gate: str | None = None  # a character without which nothing can match
    base: bool = field(default=False)


_FREE, _END = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
_IBAN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}+{_END}" for n, c in IBAN_LENGTHS.items())

KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8,
         "e-?mail|mail|contact|write|schreib|courriel|correo", gate="@", base=True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.5, "ip|ipv4|host|server|address|adresse|login|client", octets, 0.1, ".", True),
    # a whole chain of digits with single separators, of 13 to 19 digits
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", 0.4,
         "card|credit|debit|visa|master ?card|amex|karte|carte|tarjeta|payment|pan", luhn, 0.3, base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|call|tel|mobile|cell|fax|telefon|anruf|téléphone|teléfono",
         lambda m: F.length(_digits(m)).between(9, 15), 0.1, "+", True),
    Kind("iban", f"{_FREE}(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})", 0.3, "iban|account|bank|konto|compte|cuenta", mod97, 0.5),
    Kind("ssn", r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])", 0.35,
         "ssn|social security|social|security number|tax id", gate="-"),
    Kind("health", r"(?<![0-9A-Za-z-])[0-9]{3}[\x20-]?[0-9]{3}[\x20-]?[0-9]{4}(?![0-9A-Za-z-])", 0.1, "nhs|health|patient|medical", mod11, 0.2),
    Kind("routing", r"(?<![0-9A-Za-z-])[0-9]{9}(?![0-9A-Za-z-])", 0.1, "aba|routing|rtn|transit|bank", weighted371, 0.2),
    Kind("local_phone", r"(?<![0-9A-Za-z+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", 0.3,
         "phone|call|tel|mobile|cell|fax|telefon|anruf|téléphone|teléfono"),
    Kind("birth", r"(?<![0-9A-Za-z./-])(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})(?![0-9A-Za-z/-])", 0.15,
         "born|birth|birthday|dob|geboren|geburtsdatum|né|née|naissance|nacido|nacimiento", day_of_birth, 0.1),
]
BASE = [k.name for k in KINDS if k.base]
AGAINST_WORDS = "example|sample|dummy|placeholder|version|invoice|order|isbn|sku|beispiel|exemple|ejemplo"

SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _running(steps: Column) -> Column:
    """Running sums of an array of ints, in blocks."""
    def sums(x: Column) -> Column:
        return F.aggregate(x, F.expr("CAST(array() AS array<int>)"), lambda a, v: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + v)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: sums(F.slice(steps, b * BLOCK + 1, BLOCK)))
    ends = sums(F.transform(blocks, lambda x: F.get(x, F.size(x) - 1)))
    past = F.concat(F.array(F.lit(0)), ends)
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("sums"), past.alias("past")),
                                 lambda z: F.transform(F.coalesce(z["sums"], F.expr("CAST(array() AS array<int>)")), lambda v: v + z["past"])))


def _spans(df: DataFrame, text: str, kind: Kind, to: str) -> DataFrame:
    """Add `to`: the kind's spans, or null where the pattern matches nothing."""
    names = df.columns
    found, gaps, ends, seen = (f"_{to}_{x}" for x in ("found", "gaps", "ends", "seen"))
    all_of = F.regexp_extract_all(F.col(text), F.lit(kind.pattern), F.lit(0))
    df = df.withColumn(found, F.when(F.contains(F.col(text), F.lit(kind.gate)), all_of) if kind.gate else all_of)
    some = F.size(found) > 0  # null and empty are none
    df = df.withColumn(gaps, F.when(some, F.split(F.col(text), kind.pattern, -1)))
    df = df.withColumn(ends, F.when(some, F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.length(g) + F.length(m))))
    df = df.withColumn(ends, F.when(some & (F.size(ends) > 0), _running(F.col(ends))))
    # what each match is, where it ends and what stands beside it; each array is used whole, never by index
    beside = F.zip_with(F.transform(gaps, lambda g: F.right(g, F.lit(BEFORE))), F.transform(F.slice(gaps, F.lit(2), F.size(found)), lambda g: F.left(g, F.lit(AFTER))),
                        lambda a, z: F.concat(a, F.lit(" \n "), F.coalesce(z, F.lit(""))))
    df = df.withColumn(seen, F.when(some, F.arrays_zip(F.col(found).alias("m"), F.col(ends).alias("end"), F.slice(beside, F.lit(1), F.size(found)).alias("beside"))))
    if kind.confirm:
        df = df.withColumn(seen, F.filter(seen, lambda x: kind.confirm(x["m"])))

    def score(x: Column) -> Column:
        has = lambda words: x["beside"].rlike(rf"(?iU)\b(?:{words})\b")
        total = F.lit(kind.score + kind.confirmed) + F.when(has(kind.words), NEAR).otherwise(0.0) + F.when(has(AGAINST_WORDS), AGAINST).otherwise(0.0)
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 2)

    spans = F.transform(seen, lambda x: F.struct(F.lit(kind.name).alias("kind"), (x["end"] - F.length(x["m"])).alias("start"), x["end"].alias("end"), score(x).alias("score")))
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= THRESHOLD)
    return df.select(*names, F.when(some, spans).alias(to))


def with_spans(df: DataFrame, text: str = "text", to: str = "pii", kinds: list[Kind] = KINDS) -> DataFrame:
    """Every column of `df` and `to`: the spans (kind, start, end, score)."""
    names = [c for c in df.columns if c != to]
    plain = df.withColumn("_pii_text", F.coalesce(F.col(text), F.lit("")))
    for k in kinds:
        plain = _spans(plain, "_pii_text", k, f"_pii_{k.name}")
    none = F.expr(f"CAST(array() AS {SPAN})")
    return plain.select(*names, F.concat(*[F.coalesce(F.col(f"_pii_{k.name}"), none) for k in kinds]).alias(to))


def joined(spans: Column, *fields: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *[s[f].cast("string") for f in fields])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans, with
    and without scores."""
    found = with_spans(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    of = lambda *names: F.filter("pii", lambda s: s["kind"].isin(*names))
    return found.select(
        "doc_id", *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(of(*BASE), "kind", "start", "end"), 256).alias("base_sha256"),
        joined(F.col("pii"), "kind", "start", "end").alias("spans"), joined(F.col("pii"), "kind", "start", "end", "score").alias("scored"))
