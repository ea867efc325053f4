"""Format-preserving pseudonyms for personal numbers, dates and addresses, in SQL functions only.

Values are found by pattern and validated (check digits, ranges, calendar). Each
is permuted by a keyed Feistel network inside its own format: a card number turns
into another valid card number with the same grouping, a date into another date
written the same way. The same key turns equal values into equal pseudonyms in
every document, and no two values of a format share one.

A value is a list of symbols with a radix each. It is cut in halves; each round
adds to the symbols of one half, modulo their radix, numbers drawn from a keyed
hash of the other half. That is invertible for any key, so it is a permutation of
the format.

Everything happens inside the row: no shuffle, no Python, any text length. Nulls
stay null, a text without such values stays as it is, and other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import free_name

ROUNDS = 10

# Possessive and anchored at the run's start, so a long run of word characters is read once.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++){1,8}+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])"
ISO_DATE = r"(?<![0-9\-/.])[0-9]{4}([\-/.])[0-9]{2}\1[0-9]{2}(?![0-9]|[\-/.][0-9])"
DAY_DATE = r"(?<![0-9\-/.])[0-9]{2}([\-/.])[0-9]{2}\1[0-9]{4}(?![0-9]|[\-/.][0-9])"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
CARD = (
    r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?"
    r"|[0-9]{4}([ \-])[0-9]{6}\2[0-9]{5})(?![0-9])"
)
PHONE = (
    r"(?<![0-9+])(?:\+1[ .\-]?|1[ .\-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])"
    r"|\+[0-9]{1,3}(?:[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})){2,5}(?![0-9])"
)

Rewrite = Callable[[Column], Column]


def let(value: Column, body: Rewrite) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(symbols: Column, radices: Column, key: str, tweak: str) -> Column:
    """The permuted symbols: arrays of integers, ``symbols[i]`` below ``radices[i]``.

    An even number of rounds, so both halves end where they began.
    """

    def halves(a: Column) -> tuple[Column, Column]:
        cut = F.floor(F.size(a) / 2).cast("int")
        return F.slice(a, F.lit(1), cut), F.slice(a, cut + 1, F.size(a) - cut)

    def state(left: Column, right: Column, left_radices: Column, right_radices: Column) -> Column:
        return F.struct(left.alias("l"), right.alias("r"), left_radices.alias("lr"), right_radices.alias("rr"))

    def one_round(s: Column, i: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), F.array_join(s["r"].cast("array<string>"), ","))

        def shifted(x: Column, j: Column) -> Column:
            drawn = F.conv(F.substring(F.sha2(F.concat(seed, F.lit("|"), j.cast("string")), 256), 1, 13), 16, 10).cast("long")
            return F.pmod(x + drawn, F.element_at(s["lr"], j + 1))

        return state(s["r"], F.transform(s["l"], shifted), s["rr"], s["lr"])

    start = state(*halves(symbols.cast("array<long>")), *halves(radices.cast("array<long>")))
    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return F.aggregate(rounds, start, one_round, lambda s: F.concat(s["l"], s["r"]))


def characters(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(kind), F.lit(0))


def numbers(text: Column) -> Column:
    return characters(text, "[0-9]").cast("array<long>")


def refill(shape: Column, kind: str, symbols: Column) -> Column:
    """``shape`` with its characters of ``kind`` replaced in order."""
    both = F.zip_with(
        F.split(shape, kind, -1), symbols.cast("array<string>"), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
    )
    return F.array_join(both, "")


def tens(a: Column) -> Column:
    return F.transform(a, lambda x: F.lit(10).cast("long"))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of all digits, the last one taken as the check digit."""
    doubled = F.transform(
        F.reverse(digits), lambda x, i: F.when(i % 2 == 1, x * 2 - F.when(x > 4, F.lit(9)).otherwise(0)).otherwise(x)
    )
    return F.aggregate(doubled, F.lit(0).cast("long"), lambda a, x: a + x)


def card(m: Column, key: str) -> Column:
    def permuted(d: Column) -> Column:
        body = F.slice(d, F.lit(1), F.size(d) - 1)
        new = feistel(body, tens(body), key, "card")
        with_check = let(new, lambda b: F.concat(b, F.array(F.pmod(-luhn_sum(F.concat(b, F.array(F.lit(0).cast("long")))), F.lit(10)))))
        varied = F.size(F.array_distinct(d)) > 1
        return F.when(varied & (luhn_sum(d) % 10 == 0), refill(m, "[0-9]", with_check)).otherwise(m)

    return let(numbers(m), permuted)


def mod97(text: Column) -> Column:
    """A code of digits and capital letters (A = 10 and so on) modulo 97."""

    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55).cast("long")
        return (rest * F.when(value > 9, F.lit(100)).otherwise(10) + value) % 97

    return F.aggregate(characters(text, "[0-9A-Z]"), F.lit(0).cast("long"), step)


def alphanumeric(text: Column, key: str, tweak: str) -> Column:
    """Letters and digits permuted, each inside its class (lower case, upper case, digit)."""

    def permuted(chars: Column) -> Column:
        def by_class(digit: int, lower: int, upper: int) -> Rewrite:
            return lambda c: F.when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), lower).otherwise(upper).cast("long")

        base = by_class(48, 97, 65)
        symbols = F.transform(chars, lambda c: F.ascii(c).cast("long") - base(c))
        new = feistel(symbols, F.transform(chars, by_class(10, 26, 26)), key, tweak)
        return refill(text, "[A-Za-z0-9]", F.zip_with(chars, new, lambda c, x: F.char(base(c) + x)))

    return let(characters(text, "[A-Za-z0-9]"), permuted)


def iban(m: Column, key: str) -> Column:
    """Country kept, account permuted, check digits made anew."""
    plain = F.regexp_replace(m, " ", "")
    valid = (mod97(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))) == 1) & F.length(plain).between(15, 34)

    def renewed(account: Column) -> Column:
        check = F.lpad((98 - mod97(F.concat(account, F.substring(m, 1, 2), F.lit("00")))).cast("string"), 2, "0")
        return F.concat(F.substring(m, 1, 2), check, account)

    return F.when(valid, let(alphanumeric(F.substring(m, 5, 60), key, "iban"), renewed)).otherwise(m)


def email(m: Column, key: str) -> Column:
    """The local part is permuted; the domain, which names a provider, stays."""
    return F.concat(alphanumeric(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def address(m: Column, key: str) -> Column:
    def permuted(parts: Column) -> Column:
        new = feistel(parts, F.transform(parts, lambda x: F.lit(256).cast("long")), key, "address")
        return F.when(F.array_max(parts) < 256, F.array_join(new.cast("array<string>"), ".")).otherwise(m)

    return let(F.split(m, r"\.").cast("array<long>"), permuted)


def ssn(m: Column, key: str) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999."""

    def permuted(p: Column) -> Column:
        area, group, serial = (F.element_at(p, i) for i in (1, 2, 3))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        symbols = F.array(area - 1 - (area > 666).cast("long"), group - 1, serial - 1)
        new = feistel(symbols, F.array(*[F.lit(r).cast("long") for r in (898, 99, 9999)]), key, "ssn")

        def written(n: Column) -> Column:
            a = F.element_at(n, 1) + 1
            a = a + (a >= 666).cast("long")
            return F.concat_ws(
                "-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.element_at(n, 2) + 1).cast("string"), 2, "0"),
                F.lpad((F.element_at(n, 3) + 1).cast("string"), 4, "0"),
            )

        return F.when(valid, let(new, written)).otherwise(m)

    return let(F.split(m, "-").cast("array<long>"), permuted)


def phone(m: Column, key: str) -> Column:
    """The country code stays; ten digits of a North American number, else all digits after the code."""

    def permuted(d: Column) -> Column:
        code = F.when(m.startswith("+") & ~m.rlike(r"^\+1(?![0-9])"), F.length(F.regexp_extract(m, r"^\+([0-9]{1,3})", 1)))
        keep = F.coalesce(code, F.size(d) - 10)
        body = F.slice(d, keep + 1, F.size(d) - keep)
        new = F.concat(F.slice(d, F.lit(1), keep), feistel(body, tens(body), key, "phone"))
        return F.when(F.size(d).between(8, 15) & (keep >= 0), refill(m, "[0-9]", new)).otherwise(m)

    return let(numbers(m), permuted)


# Days from 1900-01-01 to 2099-12-31: 73,049 = 17 * 4297, so two symbols number them without gaps.
DAY_RADICES = (17, 4297)


def date(m: Column, key: str, year_first: bool) -> Column:
    """A calendar date of 1900 to 2099, written day first where both readings are dates."""

    def permuted(p: Column) -> Column:
        a, b, c = (F.element_at(p, i) for i in (1, 2, 3))

        def as_date(year: Column, month: Column, day: Column) -> Column:
            written = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
            found = F.try_to_date(written, "yyyy-MM-dd")
            return F.when(found.between(F.lit("1900-01-01").cast("date"), F.lit("2099-12-31").cast("date")), found)

        def renewed(day: Column, shape: str) -> Column:
            n = F.datediff(day, F.lit("1900-01-01").cast("date")).cast("long")
            symbols = F.array(n % DAY_RADICES[0], F.floor(n / DAY_RADICES[0]).cast("long"))
            new = feistel(symbols, F.array(*[F.lit(r).cast("long") for r in DAY_RADICES]), key, "date")

            def written(s: Column) -> Column:
                later = F.element_at(s, 1) + F.element_at(s, 2) * DAY_RADICES[0]
                plain = F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), later.cast("int")), shape)
                return plain

            return refill(m, "[0-9]", characters(let(new, written), "[0-9]"))

        if year_first:
            day = as_date(a, b, c)
            return F.when(day.isNotNull(), renewed(day, "yyyyMMdd")).otherwise(m)
        day, other = as_date(c, b, a), as_date(c, a, b)
        return (
            F.when(day.isNotNull(), renewed(day, "ddMMyyyy")).when(other.isNotNull(), renewed(other, "MMddyyyy")).otherwise(m)
        )

    return let(F.split(m, r"[\-/.]"), permuted)


# In order of precedence; the number is the count of back references before the pattern's own.
KINDS: tuple[tuple[str, Callable[[Column, str], Column]], ...] = (
    (EMAIL, email),
    (IBAN, iban),
    (ISO_DATE, lambda m, key: date(m, key, True)),
    (DAY_DATE, lambda m, key: date(m, key, False)),
    (ADDRESS, address),
    (SSN, ssn),
    (CARD, card),
    (PHONE, phone),
)


def _joined() -> str:
    """All patterns as alternatives, with their back references renumbered."""
    parts, groups = [], 0
    for pattern, _ in KINDS:
        parts.append(re.sub(r"\\([1-9])", lambda x: "\\" + str(int(x[1]) + groups), pattern))
        groups += re.compile(pattern).groups
    return "|".join(f"(?:{p})" for p in parts)


ANY = _joined()


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one found value; the value itself if it does not validate."""
    out = m
    for pattern, rewrite in reversed(KINDS):
        out = F.when(m.rlike(f"^(?:{pattern})$"), rewrite(m, key)).otherwise(out)
    return out


def pseudonymise(df: DataFrame, key: str, column: str = "text", count: str | None = None) -> DataFrame:
    """``df`` with the personal values of ``column`` replaced; ``count`` names a column for how many changed.

    Keep ``key`` secret: whoever knows it can invert the permutation.
    """
    text, values, new = F.col(column), free_name(df, "_values"), free_name(df, "_pseudonyms")
    out = df.withColumn(values, F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    out = out.withColumn(new, F.transform(values, lambda m: pseudonym(m, key)))
    rebuilt = F.array_join(
        F.zip_with(F.split(text, ANY, -1), new, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), ""
    )
    out = out.withColumn(column, F.when(F.size(values) > 0, rebuilt).otherwise(text))
    if not count:
        return out.select(*df.columns)
    changed = F.size(F.filter(F.zip_with(values, new, lambda a, b: a != b), lambda x: x))
    return out.select(*df.columns, F.coalesce(F.when(F.size(values) > 0, changed), F.lit(0)).alias(count))


def op10_pseudonyms(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, key="tallyloom", count="n_replaced")


QUERIES = {"op10_pseudonyms": op10_pseudonyms}
ORACLES: dict[str, str] = {}
