"""Format-preserving pseudonyms for personal data (operator 3), DataFrame functions only.

Validated numbers and dates are permuted by a keyed Feistel network inside their own format, so a
value always gets the same pseudonym, two values never share one, and what reads the text still
finds a number or date of that kind:

* payment cards (13 to 19 digits that pass the Luhn check): all digits but the last are permuted,
  the check digit is computed anew;
* account numbers (IBAN, 15 to 34 characters that pass the mod-97 check): the digits after the check
  digits are permuted, letters stay, the check digits are computed anew;
* social security numbers (three, two and four digits with hyphens, in the ranges that are issued);
* phone numbers (international, or ten digits in national form): the digits after the country code,
  which is read from the digits themselves, so a number keeps its links over all spellings;
* IPv4 addresses: the 32 bits as two halves; IPv6 addresses: both 64-bit halves, the lower one under a key of
  the upper one, written out in full;
* dates (year-month-day, day/month/year, month/day/year, day.month.year; 1801 to 2200): the day's
  number in that 400-year span of 146,097 = 189 * 773 days.

Two kinds of text that aren't numbers get a keyed hash in their own form: the local part of an
e-mail address (80 bits; case doesn't matter), and secrets written as 32 to 64 hexadecimal digits, a
decimal one among them.

Dates with slashes have two readings; the day comes first wherever that is valid.

What looks alike but isn't valid (a failed check, 31 February, an octet above 255) stays. A text
without a digit or an @ is passed on as it is; the others are cut at their matches once, and only
matches go through the expressions below. Values that an expression uses several times are bound by
``_let``, as functions on arrays work anew for each use.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"
IPV4 = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)"
IPV6 = (
    r"(?<![0-9A-Za-z:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
    r"|(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6})?::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6})?)(?![0-9A-Za-z:]|\.\d)"
)
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d]|[./-]\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d]|-\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
PHONE = (
    r"(?<![\d+])(?:\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{2,4}[ .-]\d{2,4}|\+\d{1,3}(?<sep>[ .-])\d{2,4}(?:\k<sep>\d{2,4}){1,3}"
    r"|\+\d{8,15}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\d)"
)
SECRET = r"(?<![0-9A-Za-z])(?=[a-fA-F]*+[0-9])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
#: Kinds that begin with a digit, a plus or a bracket are tried only there.
NUMBERS = rf"(?=[0-9+(])(?:{IPV4}|{DATE}|{SOCIAL}|{CARD}|{PHONE})"
ANY = "|".join((EMAIL, SECRET, IBAN, IPV6, NUMBERS))
KINDS = ("card", "iban", "social", "phone", "ip", "date", "email", "secret")
_MARK = "\u0001"
#: Country calling codes of one and of two digits; all others have three.
CALLING_ONE = ["1", "7"]
CALLING_TWO = [
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54",
    "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
]


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), value being computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _draw(key: str, kind: str, turn: Column, value: Column, tweak: Column | None = None) -> Column:
    """A number below 2**60 from key, kind, turn and value."""
    named = F.concat_ws(":", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string"), *([] if tweak is None else [tweak.cast("string")]))
    return F.conv(F.substring(F.sha2(named, 256), 1, 15), 16, 10).cast("bigint")


def _feistel(key: str, kind: str, a: Column, b: Column, size_a: Column, size_b: Column, tweak: Column | None = None) -> Column:
    """A keyed permutation of the pairs (a, b) below (size_a, size_b), 10**15 at most; a struct of bigints a, b."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(acc["a"] + _draw(key, kind, i, acc["b"], tweak), size_a)).otherwise(acc["a"]).cast("bigint").alias("a"),
            F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + _draw(key, kind, i, acc["a"], tweak), size_b)).cast("bigint").alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """A string of 2 to 30 digits to another of the same length, one to one."""
    size = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("bigint")

    def of(d: Column) -> Column:
        n = F.length(d)
        left = F.floor(n / 2).cast("int")
        p = _feistel(key, kind + "-", F.substring(d, F.lit(1), left), F.substring(d, left + 1, n - left), size(left), size(n - left))
        return _let(p, lambda p: F.concat(F.lpad(p["a"].cast("string"), left, "0"), F.lpad(p["b"].cast("string"), n - left, "0")))

    return _let(digits, of)


def luhn_digit(payload: Column) -> Column:
    """The check digit that follows these digits."""

    def of(d: Column) -> Column:
        n = F.length(d)

        def add(acc: Column, i: Column) -> Column:
            x = F.substring(d, n - i + 1, F.lit(1)).cast("int")
            return acc + F.when(i % 2 == 1, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x)

        return F.pmod(F.lit(10) - F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10, F.lit(10)).cast("string")

    return _let(payload, of)


def mod97(plain: Column) -> Column:
    """Rest of a string of digits and A to Z (as 10 to 35) by 97, the first four characters read last."""

    def add(acc: Column, c: Column) -> Column:
        x = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.pmod(acc * F.when(x > 9, 100).otherwise(10) + x, F.lit(97))

    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), add)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _put(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def of(d: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            is_digit = c.between("0", "9")
            return F.struct(
                F.concat(acc["out"], F.when(is_digit, F.substring(d, acc["k"], F.lit(1))).otherwise(c)).alias("out"),
                (acc["k"] + F.when(is_digit, 1).otherwise(0)).alias("k"),
            )

        return F.aggregate(F.split(m, ""), start, step)["out"]

    return _let(digits, of)


def _card(key: str, m: Column) -> Column:
    def of(d: Column) -> Column:
        payload = F.substring(d, F.lit(1), F.length(d) - 1)
        new = _let(permute_digits(key, "card", payload), lambda n: F.concat(n, luhn_digit(n)))
        return F.when(luhn_digit(payload) == F.right(d, F.lit(1)), _put(m, new))

    return _let(_digits(m), of)


def _iban(key: str, m: Column) -> Column:
    def of(plain: Column) -> Column:
        n = F.length(plain)
        digits = _digits(F.substring(plain, F.lit(5), n))
        valid = n.between(15, 34) & (mod97(plain) == 1) & (F.length(digits) >= 4)
        country = F.substring(plain, 1, 2)

        def checked(new: Column) -> Column:
            body = _put(F.substring(plain, F.lit(5), n), new)
            rest = _let(F.concat(country, F.lit("00"), body), lambda w: F.lit(98) - mod97(w))
            return F.concat(F.lpad(rest.cast("string"), 2, "0"), new)

        return F.when(valid, _put(m, _let(permute_digits(key, "iban", digits), checked)))

    return _let(F.replace(m, F.lit(" "), F.lit("")), of)


def _social(key: str, m: Column) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    first = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1  # 898 areas of 99 groups
    p = _feistel(key, "social", first, serial - 1, F.lit(898 * 99), F.lit(9999))

    def of(p: Column) -> Column:
        nth = F.floor(p["a"] / 99)
        a = nth + F.when(nth >= 665, 2).otherwise(1)
        part = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat_ws("-", part(a, 3), part(p["a"] % 99 + 1, 2), part(p["b"] + 1, 4))

    return F.when(valid, _let(p, of))


def _phone(key: str, m: Column) -> Column:
    def of(d: Column) -> Column:
        code = F.when(F.left(d, F.lit(1)).isin(*CALLING_ONE), 1).when(F.left(d, F.lit(2)).isin(*CALLING_TWO), 2).otherwise(3)
        code = F.when(m.startswith("+"), code).otherwise(0)
        rest = permute_digits(key, "phone", F.substring(d, code + 1, F.length(d) - code))
        return F.when(F.length(d).between(8, 15), _put(m, F.concat(F.substring(d, F.lit(1), code), rest)))

    return _let(_digits(m), of)


def _ip(key: str, m: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    part = lambda x: F.concat(F.floor(x / 256).cast("string"), F.lit("."), (x % 256).cast("string"))

    def of(o: Column) -> Column:
        p = _feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(1 << 16), F.lit(1 << 16))
        return F.when(F.forall(o, lambda x: x <= 255), _let(p, lambda p: F.concat(part(p["a"]), F.lit("."), part(p["b"]))))

    return _let(o, of)


def _ipv6(key: str, m: Column) -> Column:
    words = lambda t: F.filter(F.split(t, ":"), lambda w: w != "")

    def whole(ends: Column) -> Column:
        gap = F.lit(8) - F.size(ends[0]) - F.size(ends[1])
        filled = F.concat(ends[0], F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), ends[1])
        return F.when(F.instr(m, "::") > 0, F.when(gap > 0, filled)).otherwise(ends[0])

    def of(w: Column) -> Column:
        number = lambda k: F.conv(F.concat(*[F.lpad(w[k + i], 4, "0") for i in range(2)]), 16, 10).cast("bigint")
        size = F.lit(1 << 32)
        said = lambda x: F.concat_ws(":", *[F.lower(F.conv(n.cast("string"), 10, 16)) for n in (F.floor(x / 65536), x % 65536)])
        upper = _let(_feistel(key, "ip6", number(0), number(2), size, size), lambda p: F.concat_ws(":", said(p["a"]), said(p["b"])))
        tweak = F.concat_ws(":", number(0).cast("string"), number(2).cast("string"))
        lower = _let(_feistel(key, "ip6-", number(4), number(6), size, size, tweak), lambda p: F.concat_ws(":", said(p["a"]), said(p["b"])))
        return F.when(F.size(w) == 8, F.concat_ws(":", upper, lower))

    ends = _let(F.split(m, "::", -1), lambda e: F.array(words(e[0]), F.coalesce(words(F.get(e, F.lit(1))), F.array().cast("array<string>"))))
    return _let(_let(ends, whole), of)


def _date(key: str, m: Column) -> Column:
    first = F.lit("1801-01-01").cast("date")

    def read_as(pattern: str) -> Column:
        def new(day: Column) -> Column:
            p = _feistel(key, "date", F.floor(day / 773), day % 773, F.lit(189), F.lit(773))
            moved = _let(p, lambda p: F.date_format(F.date_add(first, (p["a"] * 773 + p["b"]).cast("int")), pattern))
            return F.when(day.between(0, 146_096), moved)

        return _let(F.datediff(F.try_to_timestamp(m, F.lit(pattern)).cast("date"), first), new)

    slashes = F.when(F.substring(m, 3, 1) == "/", F.coalesce(read_as("dd/MM/yyyy"), read_as("MM/dd/yyyy")))
    return F.when(F.substring(m, 5, 1) == "-", read_as("yyyy-MM-dd")).when(F.substring(m, 3, 1) == ".", read_as("dd.MM.yyyy")).otherwise(slashes)


def _email(key: str, m: Column) -> Column:
    at = F.instr(m, "@")
    return F.concat(
        F.lit("u"), F.substring(F.sha2(F.concat(F.lit(key + ":email:"), F.lower(m)), 256), 1, 20), F.substring(m, at, F.length(m))
    )


def _secret(key: str, m: Column) -> Column:
    new = F.substring(F.sha2(F.concat(F.lit(key + ":secret:"), F.lower(m)), 256), F.lit(1), F.length(m))
    return F.when(m.rlike("[A-F]"), F.upper(new)).otherwise(new)


def _pseudonym(key: str, m: Column) -> Column:
    """(kind, new) for a match; both null where it isn't valid."""
    whole = lambda p: m.rlike("^(?:" + p + ")$")
    found = F.lit(None).cast("struct<kind:string,new:string>")
    for kind, is_it, make in reversed(
        (
            ("email", F.contains(m, F.lit("@")), _email),
            ("secret", whole("[0-9a-fA-F]{32,64}"), _secret),
            ("iban", m.rlike("^[A-Z]{2}[0-9]{2}"), _iban),
            ("ip", F.contains(m, F.lit(":")), _ipv6),
            ("ip", whole(r"\d+(?:\.\d+){3}"), _ip),
            ("date", whole(r"\d{4}-\d\d-\d\d|\d\d([./])\d\d\1\d{4}"), _date),
            ("social", whole(r"\d{3}-\d\d-\d{4}"), _social),
            ("card", ~m.startswith("+") & ~m.startswith("(") & (F.length(_digits(m)) >= 13), _card),
            ("phone", F.lit(True), _phone),
        )
    ):
        found = F.when(is_it, F.struct(F.lit(kind).alias("kind"), make(key, m).alias("new"))).otherwise(found)
    return found


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, text with pseudonyms, and the count of each kind replaced, n_card to n_secret.

    ``key`` decides the permutations; without it they can't be undone. Plans and event logs show a
    hash of it, which is what the permutations use: keep them as safe as the key.

    Defined cases: a null text stays null with counts of 0, an empty text stays empty; a text
    without a valid match is unchanged to the byte. Texts are searched whole, however long. Equal
    values have equal pseudonyms across all rows. Null ids, repeated ids and repeated rows are carried
    on. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    key = hashlib.sha256(key.encode()).hexdigest()[:32]
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    may = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    # gaps and matches by turns; a text that holds the mark itself is read twice instead
    marked = F.split(F.regexp_replace("text", ANY, _MARK + "$0" + _MARK), _MARK, -1)
    found = lambda m: F.struct(m.alias("old"), _pseudonym(key, m).alias("p"))
    gap = lambda g: F.struct(g.alias("old"), F.lit(None).cast("struct<kind:string,new:string>").alias("p"))
    by_turns = F.transform(marked, lambda x, i: F.when(i % 2 == 1, found(x)).otherwise(gap(x)))
    gaps, matches = F.split("text", ANY, -1), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    twice = F.flatten(F.zip_with(gaps, matches, lambda g, m: F.filter(F.array(gap(g), F.when(m.isNotNull(), found(m))), lambda x: x.isNotNull())))
    parts = F.when(may, F.when(F.contains("text", F.lit(_MARK)), twice).otherwise(by_turns))
    # parts is used by all that follows, so that it is made once
    base = base.withColumn("parts", parts)
    new = F.array_join(F.transform("parts", lambda x: F.coalesce(x["p"]["new"], x["old"])), "")
    count = lambda k: F.coalesce(F.size(F.filter("parts", lambda x: (x["p"]["kind"] == k) & x["p"]["new"].isNotNull())), F.lit(0))
    return base.select(
        F.col("id").alias(id_col), F.when(F.col("parts").isNotNull(), new).otherwise(F.col("text")).alias("text"),
        *[F.greatest(count(k), F.lit(0)).alias(f"n_{k}") for k in KINDS],
    )
