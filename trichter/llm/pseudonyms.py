"""Format-preserving pseudonyms for validated numbers and dates, by a keyed Feistel network."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# What counts as a number or date of each kind. A match stands between signs that
# are neither letters, digits nor part of a longer number.
PATTERNS = (
    ("iban", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9][A-Za-z0-9-]*)*\.[A-Za-z]{2,}"),
    ("date", r"\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}"),
    ("ip", r"\d{1,3}(?:\.\d{1,3}){3}"),
    ("ssn", r"\d{3}-\d{2}-\d{4}"),
    ("card", r"\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]?\d{6}[ -]?\d{5}"),
    (
        "phone",
        r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}"
        r"|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4}"
        r"|0\d{1,4}[ /-]\d{5,9}|0\d{2,4}[ /-]\d{3,5}[ -]\d{3,5}",
    ),
)
_ANY = r"(?<![\p{L}\p{N}@.+-])(?:" + "|".join(p for _, p in PATTERNS) + r")(?![\p{L}\p{N}@]|[.-]\p{N})"

_DAYS = 146_097  # four hundred years, after which the calendar repeats
_DAY_SIDES = (189, 773)
_FIRST_DAY = -62_091  # 1800-01-01 in days since 1970-01-01
_DATE_STEPS = 200


def pseudonymise(
    docs: DataFrame, key: str, *, text_col: str = "text", found_col: str = "pseudonyms"
) -> DataFrame:
    """Replace validated personal numbers and dates in ``text_col`` by pseudonyms of the same format.

    Kinds: payment cards (13 to 19 digits, Luhn), IBANs (mod 97), social security numbers
    (possible areas), phone numbers (7 to 15 digits with a leading plus, a bracketed area or three
    groups, or 9 to 13 with a leading zero and a separated area), IPv4 addresses (parts up to 255 without
    leading zeros), dates (ISO, d.m.y, m/d/y; days that exist between 1800 and 2199) and e-mail
    addresses. What fails its check stays as it is.

    Each kind is permuted within its own set by a Feistel network of eight rounds, whose round
    function is SHA-256 of the secret ``key``, kind, round and the other half. So pseudonyms are
    valid members of the same format, two values never share one, and equal values get equal
    pseudonyms in all documents: they stay linked. Separators, brackets, letter case, country
    codes of IBANs and mail domains stay; check digits are computed anew. A letter becomes a
    letter and a digit a digit. Dates move within 400 years and keep their notation, also whether
    day and month are written with one digit or two: those of one digit move among the dates that
    can be written so, by applying the permutation until such a date comes up (it does within
    200 times but for a chance of 1e-21 a date; such a date would stay as it is).

    The key enters the plan as a scalar subquery over one row that holds its digest, so neither
    appears in plans, in the event log or on a web page.

    Returns the columns of ``docs`` with the new text and ``found_col`` (how many values were
    replaced; a column of this name is replaced). Null texts stay null with 0. Rows are
    independent: ids, repeated rows and other columns, whatever their names, pass unchanged; an
    empty table stays empty. Only built-in expressions are used, in one pass without a shuffle.
    """
    if not key:
        raise ValueError("a key is needed")
    docs = docs.drop(found_col)
    digest = hashlib.sha256(key.encode()).hexdigest()
    secret = docs.sparkSession.createDataFrame([(digest,)], "secret string").scalar()
    rows = docs.select(F.struct("*").alias("doc"), docs[text_col].alias("text"), secret.alias("secret"))
    text = F.col("text")
    parts = F.split(text, _ANY, -1)
    hits = F.transform(F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)), lambda m: _replaced(m, F.col("secret")))
    held = F.when(F.regexp_like(text, F.lit(_ANY)), F.array(F.struct(parts.alias("parts"), hits.alias("hits"))))
    # A generator of one row keeps the optimizer from writing the long expression out twice.
    met = rows.select("doc", "text", F.explode_outer(held).alias("met"))
    pieces = F.transform(
        "met.parts", lambda part, n: F.concat(part, F.coalesce(F.get(F.col("met.hits"), n)["text"], F.lit("")))
    )
    changed = F.when(F.col("met").isNull(), text).otherwise(F.array_join(pieces, ""))
    count = F.coalesce(F.size(F.filter("met.hits", lambda h: h["valid"])), F.lit(0))
    columns = [(changed if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns]
    return met.select(*columns, count.alias(found_col))


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _replaced(match: Column, key: Column) -> Column:
    """``text, valid`` of one match."""
    digits = F.regexp_replace(match, r"\D", "")
    fits = {name: F.regexp_like(match, F.lit(f"^(?:{pattern})$")) for name, pattern in PATTERNS}
    results = {
        "iban": _bind(F.replace(match, F.lit(" "), F.lit("")), lambda x: _iban(match, x, key)),
        "email": _email(match, key),
        "date": _date(match, key),
        "ip": _ip(match, key),
        "ssn": _bind(digits, lambda d: _ssn(match, d, key)),
        "card": _bind(digits, lambda d: _card(match, d, key)),
        "phone": _bind(digits, lambda d: _phone(match, d, key)),
    }
    # The first kind that fits and whose check passes; a long number may fit a card and a phone.
    new = F.coalesce(*[F.when(fits[name], results[name]) for name, _ in PATTERNS])
    return _bind(new, lambda text: F.struct(F.coalesce(text, match).alias("text"), text.isNotNull().alias("valid")))


# The network


def _random(key: Column | str, kind: Column | str, round_: Column, half: Column) -> Column:
    """60 bits of SHA-256 over key, kind, round and half."""
    words = F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), half.cast("string"), F.lit(key))
    return F.conv(F.substring(F.sha2(words, 256), 1, 15), 16, 10).cast("bigint")


def permuted(left: Column, right: Column, left_size, right_size, key: Column | str, kind: str) -> Column:
    """``left, right`` moved within the product of the two ranges: each round adds to one half a number that depends on the other."""
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def step(state: Column, n: Column) -> Column:
        moved_left = F.pmod(state["l"] + _random(key, kind, n, state["r"]), left_size)
        moved_right = F.pmod(state["r"] + _random(key, kind, n, state["l"]), right_size)
        on_left = n % 2 == 0
        return F.struct(
            F.when(on_left, moved_left).otherwise(state["l"]).cast("bigint").alias("l"),
            F.when(on_left, state["r"]).otherwise(moved_right).cast("bigint").alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _permuted_digits(digits: Column, key: Column | str, kind: Column | str) -> Column:
    """A string of 2 to 36 digits as another one of the same length."""
    size = F.length(digits)
    half = F.floor(size / 2).cast("int")
    left_size = F.pow(F.lit(10.0), half).cast("bigint")
    right_size = F.pow(F.lit(10.0), size - half).cast("bigint")
    kind_and_size = F.concat_ws(":", F.lit(kind), size.cast("string"))
    left, right = F.substr(digits, F.lit(1), half), F.substr(digits, half + 1)
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def step(state: Column, n: Column) -> Column:
        on_left = n % 2 == 0
        other = F.when(on_left, state["r"]).otherwise(state["l"])
        noise = _random(key, kind_and_size, n, other)
        return F.struct(
            F.when(on_left, F.pmod(state["l"] + noise, left_size)).otherwise(state["l"]).cast("bigint").alias("l"),
            F.when(on_left, state["r"]).otherwise(F.pmod(state["r"] + noise, right_size)).cast("bigint").alias("r"),
        )

    moved = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return _bind(
        moved,
        lambda m: F.concat(F.lpad(m["l"].cast("string"), half, "0"), F.lpad(m["r"].cast("string"), size - half, "0")),
    )


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _permuted_signs(text: Column, key: Column | str, kind: str) -> Column:
    """Letters as other letters and digits as other digits, by a network over the two halves of the text.

    Each round adds to every sign of one half, modulo 26 or 10, a number that depends on its place
    and on the other half. Upper and lower case stay and do not matter to the numbers.
    """
    size = F.length(text)
    half = F.floor(size / 2).cast("int")
    kind_and_size = F.concat_ws(":", F.lit(kind), size.cast("string"))
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))

    def added(part: Column, other: Column, n: Column) -> Column:
        def moved(sign: Column, place: Column) -> Column:
            noise = _random(key, kind_and_size, n * 1000 + place, F.lower(other))
            number = F.instr(F.lit(_LETTERS), F.lower(sign)) - 1
            letter = F.substr(F.lit(_LETTERS), (F.pmod(number + noise, F.lit(26)) + 1).cast("int"), F.lit(1))
            return (
                F.when(F.regexp_like(sign, F.lit("^[0-9]$")), F.pmod(sign.cast("int") + noise, F.lit(10)).cast("string"))
                .when(F.regexp_like(sign, F.lit("^[a-z]$")), letter)
                .when(F.regexp_like(sign, F.lit("^[A-Z]$")), F.upper(letter))
                .otherwise(sign)
            )

        return F.array_join(F.transform(F.split(part, ""), moved), "")

    def step(state: Column, n: Column) -> Column:
        on_left = n % 2 == 0
        return F.struct(
            F.when(on_left, added(state["l"], state["r"], n)).otherwise(state["l"]).alias("l"),
            F.when(on_left, state["r"]).otherwise(added(state["r"], state["l"], n)).alias("r"),
        )

    moved = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return _bind(moved, lambda m: F.concat(m["l"], m["r"]))


def _into_format(match: Column, signs: Column, places: str = "^[0-9]$") -> Column:
    """The signs, one after the other, in those places of the match that hold a digit (or what ``places`` says)."""
    state = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))

    def step(acc: Column, sign: Column) -> Column:
        is_place = F.regexp_like(sign, F.lit(places))
        return F.struct(
            F.concat(acc["text"], F.when(is_place, F.substr(signs, acc["next"], F.lit(1))).otherwise(sign)).alias("text"),
            (acc["next"] + F.when(is_place, 1).otherwise(0)).alias("next"),
        )

    return F.aggregate(F.split(match, ""), state, step, lambda acc: acc["text"])


# Kinds: each gives the pseudonym, or null where the check fails


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits from the right, every second one doubled."""
    signs = F.split(F.reverse(digits), "")
    return F.aggregate(
        F.transform(
            signs,
            lambda s, n: F.when(n % 2 == 0, s.cast("int")).otherwise(
                F.when(s.cast("int") > 4, s.cast("int") * 2 - 9).otherwise(s.cast("int") * 2)
            ),
        ),
        F.lit(0),
        lambda total, value: total + F.coalesce(value, F.lit(0)),
    )


def _card(match: Column, digits: Column, key: Column) -> Column:
    """All digits but the check digit move; the check digit follows."""
    size = F.length(digits)
    valid = size.between(13, 19) & (luhn_sum(digits) % 10 == 0)
    payload = F.substr(digits, F.lit(1), size - 1)
    moved = _bind(
        _permuted_digits(payload, key, "card"),
        lambda p: F.concat(p, F.pmod(-luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")),
    )
    return F.when(valid, _bind(moved, lambda d: _into_format(match, d)))


def _phone(match: Column, digits: Column, key: Column) -> Column:
    """The last digits move, at most nine; what stands before (country and area) stays, as does a leading zero."""
    size = F.length(digits)
    national = F.startswith(match, F.lit("0"))
    kept = F.greatest(size - 9, national.cast("int"))
    moved = F.concat(F.substr(digits, F.lit(1), kept), _permuted_digits(F.substr(digits, kept + 1), key, "phone"))
    grouped = F.regexp_like(match, F.lit(r"^\d{3}[ .-]\d{3}[ .-]\d{4}$"))
    valid = F.when(national & ~grouped, size.between(9, 13)).otherwise(size.between(7, 15))
    return F.when(valid, _bind(moved, lambda d: _into_format(match, d)))


def _ssn(match: Column, digits: Column, key: Column) -> Column:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001."""
    area = F.substr(digits, F.lit(1), F.lit(3)).cast("int")
    rest = F.substr(digits, F.lit(4)).cast("int")
    group, serial = F.floor(rest / 10_000), rest % 10_000
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)
    moved = permuted(place, (group - 1) * 9_999 + serial - 1, F.lit(898), F.lit(99 * 9_999), key, "ssn")

    def written_out(m: Column) -> Column:
        new_area = m["l"] + F.when(m["l"] >= 665, 2).otherwise(1)
        new_rest = (F.floor(m["r"] / 9_999) + 1) * 10_000 + m["r"] % 9_999 + 1
        return F.concat(F.lpad(new_area.cast("string"), 3, "0"), F.lpad(new_rest.cast("string"), 6, "0"))

    return F.when(valid, _bind(_bind(moved, written_out), lambda d: _into_format(match, d)))


def _ip(match: Column, key: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda p: p.cast("int"))
    valid = F.forall(parts, lambda p: p <= 255) & ~F.regexp_like(match, F.lit(r"(^|\.)0[0-9]"))
    moved = _bind(
        parts,
        lambda p: permuted(
            F.get(p, 0) * 256 + F.get(p, 1), F.get(p, 2) * 256 + F.get(p, 3), F.lit(65_536), F.lit(65_536), key, "ip"
        ),
    )
    out = _bind(
        moved,
        lambda m: F.concat_ws(
            ".", *[x.cast("string") for side in ("l", "r") for x in (F.floor(m[side] / 256), m[side] % 256)]
        ),
    )
    return F.when(valid, out)


def _date(match: Column, key: Column) -> Column:
    """Day numbers of 400 years move; the notation stays, with as many digits in each place as before."""
    iso = F.regexp_like(match, F.lit("^[0-9]{4}-"))
    dotted = F.contains(match, F.lit("."))

    def pseudonym(parts: Column) -> Column:
        first, second, third = (F.get(parts, i) for i in range(3))
        year = F.when(iso, first).otherwise(third)
        month = F.when(iso | dotted, second).otherwise(first)
        day = F.when(iso, third).otherwise(F.when(dotted, first).otherwise(second))
        short_day, short_month = F.length(day) == 1, F.length(month) == 1
        start = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")

        def written_alike(other: Column) -> Column:
            return (~short_day | (F.dayofmonth(other) < 10)) & (~short_month | (F.month(other) < 10))

        def noted(other: Column) -> Column:
            new_day = F.when(short_day, F.date_format(other, "d")).otherwise(F.date_format(other, "dd"))
            new_month = F.when(short_month, F.date_format(other, "M")).otherwise(F.date_format(other, "MM"))
            new_year = F.date_format(other, "yyyy")
            return (
                F.when(iso, F.concat_ws("-", new_year, new_month, new_day))
                .when(dotted, F.concat_ws(".", new_day, new_month, new_year))
                .otherwise(F.concat_ws("/", new_month, new_day, new_year))
            )

        def walk(state: Column, _: Column) -> Column:
            again = _bind(_moved_day(state["day"], key), lambda d: F.struct(d.alias("day"), written_alike(d).alias("there")))
            return F.when(state["there"], state).otherwise(again)

        def walked(first_day: Column) -> Column:
            begin = F.struct(first_day.alias("day"), F.lit(False).alias("there"))
            return F.aggregate(F.sequence(F.lit(1), F.lit(_DATE_STEPS)), begin, walk)

        in_range = F.year(start).between(1800, 2199)
        return F.when(in_range, _bind(_bind(start, walked), lambda s: F.when(s["there"], noted(s["day"]))))

    return _bind(F.split(match, "[-./]"), pseudonym)


def _moved_day(day: Column, key: Column) -> Column:
    number = F.unix_date(day) - _FIRST_DAY
    rows, width = _DAY_SIDES
    state = permuted(F.floor(number / width), number % width, F.lit(rows), F.lit(width), key, "date")
    return _bind(state, lambda m: F.date_from_unix_date((m["l"] * width + m["r"] + _FIRST_DAY).cast("int")))


def _email(match: Column, key: Column) -> Column:
    """Letters and digits before the at sign move; other signs and the domain stay."""
    name, domain = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    return F.concat(_bind(name, lambda n: _permuted_signs(n, key, "email")), F.lit("@"), domain)


def _mod97(signs: Column) -> Column:
    """A string of digits and letters (A = 10 ... Z = 35) as a number modulo 97."""
    return F.aggregate(
        F.split(signs, ""),
        F.lit(0),
        lambda rest, s: F.when(s == "", rest)
        .when(F.regexp_like(s, F.lit("^[0-9]$")), (rest * 10 + s.cast("int")) % 97)
        .otherwise((rest * 100 + F.ascii(s) - 55) % 97)
        .cast("int"),
    )


def _iban(match: Column, compact: Column, key: Column) -> Column:
    """The country stays, letters and digits behind the check digits move, the check digits follow."""
    country, account = F.substr(compact, F.lit(1), F.lit(2)), F.substr(compact, F.lit(5))
    valid = F.length(compact).between(15, 34) & (F.length(F.regexp_replace(account, r"\D", "")) >= 4)
    valid = valid & (_mod97(F.concat(account, F.substr(compact, F.lit(1), F.lit(4)))) == 1)

    def with_check(new: Column) -> Column:
        check = 98 - _mod97(F.concat(new, country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), new)

    moved = _bind(_permuted_signs(account, key, "iban"), with_check)
    return F.when(valid, _bind(moved, lambda signs: _into_format(match, signs, "^[0-9A-Z]$")))
