from __future__ import annotations

import hashlib
import random
import re
from datetime import date, timedelta

import regex
from pyspark.sql import functions as F

from trichter.llm import pseudonyms
from trichter.llm.pseudonyms import permuted, pseudonymise
from trichter.llm.registered import QUERIES

KEY = "k1"


def luhn(digits):
    return sum(int(c) if n % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for n, c in enumerate(reversed(digits))) % 10 == 0


def mod97(iban):
    compact = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def shape(text):
    return re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", text)))


def changed(spark, texts, key=KEY):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pseudonymise(frame, key).orderBy("doc_id").collect()]


def test_first_day_and_factors():
    assert date(1970, 1, 1) + timedelta(pseudonyms._FIRST_DAY) == date(1800, 1, 1)
    assert (date(2200, 1, 1) - date(1800, 1, 1)).days == pseudonyms._DAYS == 189 * 773


def test_network_is_a_permutation(spark):
    pairs = spark.range(7 * 11).select(F.floor(F.col("id") / 11).alias("l"), (F.col("id") % 11).alias("r"))
    moved = pairs.select(permuted(F.col("l"), F.col("r"), F.lit(7), F.lit(11), KEY, "t").alias("m")).collect()
    assert sorted((r.m.l, r.m.r) for r in moved) == [(i, j) for i in range(7) for j in range(11)]


def test_pseudonyms_stay_valid_members_of_their_format(spark):
    values = {
        "card": ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005"],
        "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
        "ssn": ["123-45-6789", "899-01-0001"],
        "ip": ["233.254.104.120", "10.0.0.1"],
        "date": ["2024-02-29", "31.12.1999", "7/4/2021"],
        "phone": ["+1 (017) 555-7713", "(974) 555-3436", "555-123-4567", "+4915112345678", "0171 1234567", "030 12345678"],
        "email": ["und.34@mail7.example.com", "Anna_B@x.org"],
    }
    flat = [(kind, v) for kind, some in values.items() for v in some]
    got = changed(spark, [f"See {v}, and again {v}." for _, v in flat])
    for (kind, old), text in zip(flat, got):
        new = re.fullmatch(r"See (.*), and again \1\.", text)[1]
        assert new != old, old
        if kind != "ip":
            assert shape(new) == shape(old)
        digits = re.sub(r"\D", "", new)
        if kind == "card":
            assert luhn(digits)
        if kind == "iban":
            assert mod97(new) == 1 and new[:2] == old[:2]
        if kind == "ssn":
            assert 0 < int(digits[:3]) < 900 and digits[:3] != "666" and digits[3:5] != "00" and digits[5:] != "0000"
        if kind == "ip":
            assert all(0 <= int(p) <= 255 for p in new.split("."))
        if kind == "email":
            assert new.split("@")[1] == old.split("@")[1]
    assert date.fromisoformat(got[[v for _, v in flat].index("2024-02-29")][4:14])
    assert changed(spark, ["4111111111111111"], "k2") != changed(spark, ["4111111111111111"])


def test_what_fails_its_check_stays(spark):
    texts = [
        "4111111111111112 and 2023-02-29, 31.02.2020, 13/13/2020",
        "DE89370400440532013001 000-12-3456 666-12-3456 123-00-1234",
        "010.0.0.1 05/2021 0123 4567 300.1.1.1 version 2.0. 4.0 1234 12 34 2020 2021 10-12 a@b x4111111111111111 1999-12-31-5",
        "",
        "only words, none else",
    ]
    assert changed(spark, texts) == texts


def test_edge_rows(spark):
    long_text = "word " * 50_000 + "4111111111111111"
    rows = [(1, None, "a"), (1, "", "a"), (None, "4111111111111111", "a"), (2, long_text, "a"), (2, "4111111111111111", "a")]
    got = pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, pseudonyms string"), KEY).collect()
    assert [(r.doc_id, r.pseudonyms) for r in got] == [(1, 0), (1, 0), (None, 1), (2, 1), (2, 1)]
    assert got[0].text is None and got[1].text == ""
    assert got[2].text == got[4].text == got[3].text[-16:] and got[3].text[:-16] == long_text[:-16]
    assert pseudonymise(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0


def test_query_leaves_no_valid_number_and_touches_nothing_else(spark):
    folder = "/root/testdata/sf0.01"
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op3_feistel_pseudonyms"](spark, folder).collect()
    assert len(rows) == len(old)
    number = re.compile(r"(?<!\d)\d{16}(?!\d)|\(\d{3}\) \d{3}-\d{4}|[\w.]+@[\w.]+\.com|\d+\.\d+\.\d+\.\d+")
    seen = 0
    for r in rows:
        before, after = number.findall(old[r.doc_id]), number.findall(r.text)
        private = [v for v in before if not re.fullmatch(r"\d{16}", v) or luhn(v)]
        assert not set(private) & set(after)
        assert number.sub("", old[r.doc_id]).replace("+1 ", "") == number.sub("", r.text).replace("+1 ", "") or "+1" in old[r.doc_id]
        seen += len(private)
        assert (r.text == old[r.doc_id]) == (r.pseudonyms == 0)
    assert seen > 20


# The same by plain Python, one value after the other


def noise(secret, kind, n, half):
    return int(hashlib.sha256("|".join((secret, kind, str(n), str(half), secret)).encode()).hexdigest()[:15], 16)


def network(left, right, left_size, right_size, secret, kind):
    for n in range(8):
        if n % 2 == 0:
            left = (left + noise(secret, kind, n, right)) % left_size
        else:
            right = (right + noise(secret, kind, n, left)) % right_size
    return left, right


def moved_digits(digits, secret, kind):
    half = len(digits) // 2
    rest = len(digits) - half
    left, right = network(int(digits[:half] or 0), int(digits[half:]), 10**half, 10**rest, secret, f"{kind}:{len(digits)}")
    return (str(left).zfill(half) if half else "") + str(right).zfill(rest)


def moved_signs(text, secret, kind):
    half = len(text) // 2
    sides = [text[:half], text[half:]]
    for n in range(8):
        part, other = sides[n % 2], sides[1 - n % 2]
        new = ""
        for place, sign in enumerate(part):
            add = noise(secret, f"{kind}:{len(text)}", n * 1000 + place, other.lower())
            if sign in "0123456789":
                sign = str((int(sign) + add) % 10)
            elif sign.isascii() and sign.isalpha():
                base = 65 if sign.isupper() else 97
                sign = chr((ord(sign) - base + add) % 26 + base)
            new += sign
        sides[n % 2] = new
    return "".join(sides)


def filled(match, signs, places=r"[0-9]"):
    signs = iter(signs)
    return re.sub(places, lambda m: next(signs), match)


def plain_date(match, secret):
    parts = re.split("[-./]", match)
    order = "ymd" if "-" in match else "dmy" if "." in match else "mdy"
    written = dict(zip(order, parts))
    try:
        day = date(int(written["y"]), int(written["m"]), int(written["d"]))
    except ValueError:
        return None
    if not 1800 <= day.year <= 2199:
        return None
    while True:
        left, right = divmod((day - date(1800, 1, 1)).days, 773)
        left, right = network(left, right, 189, 773, secret, "date")
        day = date(1800, 1, 1) + timedelta(left * 773 + right)
        new = {"y": str(day.year), "m": str(day.month).zfill(len(written["m"])), "d": str(day.day).zfill(len(written["d"]))}
        if all(len(new[c]) == len(written[c]) for c in order):
            return re.search("[-./]", match)[0].join(new[c] for c in order)


def plain_value(kind, match, secret):
    digits = re.sub(r"[^0-9]", "", match)
    if kind == "iban":
        compact = match.replace(" ", "")
        if not 15 <= len(compact) <= 34 or len(re.sub(r"[^0-9]", "", compact[4:])) < 4 or mod97(compact) != 1:
            return None
        new = moved_signs(compact[4:], secret, "iban")
        check = next(c for c in range(2, 99) if mod97(f"{compact[:2]}{c:02}{new}") == 1)
        return filled(match, f"{compact[:2]}{check:02}{new}", "[0-9A-Z]")
    if kind == "email":
        name, domain = match.split("@")
        return f"{moved_signs(name, secret, 'email')}@{domain}"
    if kind == "date":
        return plain_date(match, secret)
    if kind == "ip":
        parts = match.split(".")
        if any(int(p) > 255 or str(int(p)) != p for p in parts):
            return None
        a, b, c, d = map(int, parts)
        left, right = network(a * 256 + b, c * 256 + d, 65536, 65536, secret, "ip")
        return ".".join(map(str, (*divmod(left, 256), *divmod(right, 256))))
    if kind == "ssn":
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        areas = [a for a in range(1, 900) if a != 666]
        if area not in areas or not group or not serial:
            return None
        left, right = network(areas.index(area), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, secret, "ssn")
        return filled(match, f"{areas[left]:03}{right // 9999 + 1:02}{right % 9999 + 1:04}")
    if kind == "card":
        if not 13 <= len(digits) <= 19 or not luhn(digits):
            return None
        new = moved_digits(digits[:-1], secret, "card")
        return filled(match, new + next(c for c in "0123456789" if luhn(new + c)))
    national = match[0] == "0"
    least, most = (9, 13) if national and not re.fullmatch(r"\d{3}[ .-]\d{3}[ .-]\d{4}", match) else (7, 15)
    if not least <= len(digits) <= most:
        return None
    kept = max(len(digits) - 9, int(national))
    return filled(match, digits[:kept] + moved_digits(digits[kept:], secret, "phone"))


def plain(text, key):
    secret = hashlib.sha256(key.encode()).hexdigest()

    def new(m):
        for kind, pattern in pseudonyms.PATTERNS:
            if regex.fullmatch(pattern, m[0], regex.ASCII):
                found = plain_value(kind, m[0], secret)
                if found is not None:
                    return found
        return m[0]

    return regex.sub(pseudonyms._ANY, new, text, flags=regex.ASCII)


def made_up(seed):
    """Values of all kinds, right and wrong, in all notations."""
    rng = random.Random(seed)

    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def with_luhn(payload):
        return payload + next(c for c in "0123456789" if luhn(payload + c))

    def with_check(country, account):
        return f"{country}{next(c for c in range(2, 99) if mod97(f'{country}{c:02}{account}') == 1):02}{account}"

    card = with_luhn(digits(15))
    values = [
        card, " ".join(card[i : i + 4] for i in range(0, 16, 4)), with_luhn("3" + digits(13)), digits(16),
        with_check("DE", digits(18)), with_check("GB", "WEST" + digits(14)), "DE" + digits(20),
        f"{digits(3)}-{digits(2)}-{digits(4)}", ".".join(str(rng.randrange(300)) for _ in range(4)),
        f"{rng.randrange(1790, 2210)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 32):02}",
        f"{rng.randrange(1, 32)}.{rng.randrange(1, 13)}.{rng.randrange(1800, 2200)}",
        f"{rng.randrange(1, 10)}/{rng.randrange(1, 10)}/{rng.randrange(1800, 2200)}",
        f"{rng.randrange(1, 10)}/{rng.randrange(1, 32):02}/{rng.randrange(1800, 2200)}",
        f"+{digits(2)} {digits(3)} {digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"0{digits(3)} {digits(7)}",
        f"{rng.choice('aBc')}{rng.choice(['', '.x', '_Y9', '-longer.Name'])}{digits(2)}@mail.example.org",
    ]
    return " and ".join(values)


def test_equals_plain_python(spark):
    texts = [made_up(seed) for seed in range(60)] + ["a@b.de x@y.org 7/4/2021 07/04/2021 7/04/2021 07/4/2021"]
    want = [plain(text, KEY) for text in texts]
    assert changed(spark, texts) == want and all(a != b for a, b in zip(texts, want))
    single = [v for text in texts for v in text.split(" and ")]
    assert len({plain(v, KEY) for v in single}) == len(set(single))
    assert plain("Ann.B@x.de", KEY).lower() == plain("ann.b@x.de", KEY)


def test_whole_table_equals_plain_python(spark):
    spark.conf.set("trichter.pseudonym.secret", KEY)
    try:
        rows = QUERIES["op3_feistel_pseudonyms"](spark, "/root/testdata/sf0.01").collect()
    finally:
        spark.conf.unset("trichter.pseudonym.secret")
    old = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert {r.doc_id: r.text for r in rows} == {doc: None if text is None else plain(text, KEY) for doc, text in old.items()}


def test_short_dates_are_permuted_among_themselves(spark):
    days = [date(1800, 1, 1) + timedelta(n) for n in range(0, 146_097, 211)]
    short = [f"{d.day}.{d.month}.{d.year}" for d in days]
    new = changed(spark, short)
    assert len(set(new)) == len(new) and [shape(t) for t in new] == [shape(t) for t in short]


def test_the_key_is_in_no_plan(spark):
    secret = "a most private key"
    frame = pseudonymise(spark.createDataFrame([(1, "4111111111111111")], "doc_id long, text string"), secret)
    frame.collect()
    shown = frame._jdf.queryExecution().toString() + frame._jdf.queryExecution().executedPlan().treeString()
    assert secret not in shown and hashlib.sha256(secret.encode()).hexdigest() not in shown
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()


def test_columns_of_any_name(spark):
    names = ("doc", "met", "secret", "parts", "_met", "a.b")
    frame = spark.createDataFrame([(1, "4111111111111111", *range(len(names)))], ["doc_id", "text", *names])
    got = pseudonymise(frame, KEY)
    assert got.columns == [*frame.columns, "pseudonyms"]
    row = got.first()
    assert tuple(row[2:-1]) == tuple(range(len(names))) and row.pseudonyms == 1
