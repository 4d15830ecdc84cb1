"""Format-preserving Feistel pseudonyms (operator 5), in DataFrame functions only.

E-mail addresses, card numbers, telephone numbers, IPv4 addresses and dates are found and validated;
each is replaced by a keyed permutation of the values of its own format, so that equal values stay
equal over all documents, different ones stay different, and the key's holder can invert it.

The permutation is an unbalanced Feistel network over the value's places: even and odd places form
the two halves, and in each round every place of one half is shifted, within its own alphabet, by
a keyed hash of the other half.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colpack.llm.common import let

ROUNDS = 8
#: Splits a string into its characters.
CHARACTERS = r"(?!^)(?!$)"
#: Characters that may stand before an address and are no part of it.
BEFORE = r"^[._%+-]*"

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What is looked for, in order of preference at one place.  Repeats without a bound are possessive
#: and begin where no other could have begun before, so a search is linear and needs no deep stack.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "date": r"(?<![\d-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?![\d.]*\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ -]?)?(?:\(\d{3}\) ?|\d{3}[ -])\d{3}[ -]\d{4}(?![\w-])",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])",
}
ANY = "|".join(PATTERNS.values())
LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Days from 1900-01-01 to 2099-12-31, and a square that holds as many.
FIRST_DAY, DAYS, SIDE = "1900-01-01", 73049, 271


def _shift(key: str, kind: str, round_no: Column, other: Column, place: Column) -> Column:
    """A keyed hash of the other half's hash, up to 2**48."""
    said = F.concat_ws("|", F.lit(key), F.lit(kind), round_no.cast("string"), place.cast("string"), other)
    return F.conv(F.substring(F.sha2(said, 256), 1, 12), 16, 10).cast("bigint")


def _network(places: Column, turned, key: str, kind: str, rounds: int = ROUNDS, inverse: bool = False) -> Column:
    """Feistel rounds over an array of places; turned(place, shift) moves one within its alphabet."""

    def one(acc: Column, r: Column) -> Column:
        number = F.lit(rounds - 1) - r if inverse else r
        half = number % 2
        # hashed once a round, so that a long value costs no more than its length
        other = F.sha2(F.array_join(F.filter(F.transform(acc, lambda x: x.cast("string")), lambda _, i: i % 2 != half), ","), 256)
        sign = -1 if inverse else 1
        return let(other, lambda o: F.transform(acc, lambda x, i: F.when(i % 2 == half, turned(x, sign * _shift(key, kind, number, o, i))).otherwise(x)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), places, one)


def _turn_letter(c: Column, by: Column) -> Column:
    """A letter or digit moved within its alphabet; any other character stays."""
    out = c
    for alphabet in (LOWER, LOWER.upper(), DIGITS):
        at = F.instr(F.lit(alphabet), c)
        n = len(alphabet)
        out = F.when(at > 0, F.substring(F.lit(alphabet), F.pmod(at - 1 + by, F.lit(n)).cast("int") + 1, F.lit(1))).otherwise(out)
    return out


def permuted_text(value: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """A string with its letters and digits permuted within the strings of the same shape."""
    return F.array_join(_network(F.split(value, CHARACTERS, -1), _turn_letter, key, kind, inverse=inverse), "")


def permuted_digits(value: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """value with its digits permuted among all strings of as many digits, whatever separates them."""
    digits = F.regexp_replace(value, r"\D", "")
    return let(permuted_text(digits, key, kind, inverse), lambda new: _laid_out(value, new))


def _laid_out(value: Column, digits: Column) -> Column:
    """digits in the places of the digits of value."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda acc, c: F.when(c.rlike(r"\d"), F.struct(F.concat(acc["out"], F.substring(digits, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at")))
    return F.aggregate(F.split(value, CHARACTERS, -1), start, step, lambda acc: acc["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, its last one being the check digit."""
    places = F.reverse(F.transform(F.split(digits, CHARACTERS, -1), lambda c: c.cast("int")))
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(places, lambda d, i: F.when(i % 2 == 1, double(d)).otherwise(d)), F.lit(0), lambda a, d: a + d)


def permuted_card(value: Column, key: str, inverse: bool = False) -> Column:
    """A valid card number permuted among those of its length: all but the check digit, which follows."""

    def checked(body: Column) -> Column:
        return F.concat(body, F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))

    digits = F.regexp_replace(value, r"\D", "")
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return let(let(permuted_text(body, key, "card", inverse), checked), lambda new: _laid_out(value, new))


def permuted_ip(value: Column, key: str, inverse: bool = False) -> Column:
    octets = F.transform(F.split(value, r"\.", -1), lambda x: x.cast("bigint"))
    return F.array_join(F.transform(_network(octets, lambda x, by: F.pmod(x + by, F.lit(256)), key, "ip", inverse=inverse), lambda x: x.cast("string")), ".")


def permuted_date(value: Column, key: str, inverse: bool = False) -> Column:
    """A day permuted among those of two centuries, by walking the cycle of a slightly larger square."""
    day = F.date_diff(value.cast("date"), F.lit(FIRST_DAY).cast("date")).cast("bigint")

    def step(d: Column) -> Column:
        places = F.array((d / SIDE).cast("bigint"), d % SIDE)
        return let(_network(places, lambda x, by: F.pmod(x + by, F.lit(SIDE)), key, "date", inverse=inverse), lambda p: p[0] * SIDE + p[1])

    # outside the days lie SIDE**2 - DAYS values, so that many more steps surely come back
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(SIDE * SIDE - DAYS)), step(day), lambda d, _: F.when(d < DAYS, d).otherwise(step(d)))
    return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), walk.cast("int")), "yyyy-MM-dd")


def kind_of(value: Column) -> Column:
    """Kind of a found value, or null if it is not valid."""
    digits = F.regexp_replace(value, r"\D", "")
    return (
        F.when(F.contains(value, F.lit("@")), F.lit("email"))
        .when(value.rlike(r"^\d{4}-\d\d-\d\d$"), F.when(F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).isNotNull(), F.lit("date")))
        .when(value.rlike(r"^\d+(\.\d+){3}$"), F.lit("ip"))
        .when(F.length(digits).between(13, 19) & ~value.rlike(r"[+(]"), F.when(luhn_sum(digits) % 10 == 0, F.lit("card")))
        .otherwise(F.lit("phone"))
    )


def pseudonym(value: Column, kind: Column, key: str, inverse: bool = False) -> Column:
    """The value of that kind under the key; a null kind leaves it as it is.

    An address keeps its domain and the marks before it, a telephone number its country code.
    """
    before = F.regexp_extract(value, BEFORE, 0)
    at = F.instr(value, "@")
    prefix = F.regexp_extract(value, r"^(\+\d{1,3}[ -]?(?=\(|\d{3}[ -]))?", 0)
    return (
        F.when(kind == "email", F.concat(before, permuted_text(F.substring(value, F.length(before) + 1, at - 1 - F.length(before)), key, "email", inverse), F.substring(value, at, F.length(value))))
        .when(kind == "date", permuted_date(value, key, inverse))
        .when(kind == "ip", permuted_ip(value, key, inverse))
        .when(kind == "card", permuted_card(value, key, inverse))
        .when(kind == "phone", F.concat(prefix, permuted_digits(F.substring(value, F.length(prefix) + 1, F.length(value)), key, "phone", inverse)))
        .otherwise(value)
    )


def pseudonymize(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", inverse: bool = False) -> DataFrame:
    """(id, text, n_email, n_date, n_ip, n_phone, n_card): each text with its valid values replaced.

    Whoever has the key can invert it, so it has no default.

    What looks like a card number or date but fails its check is left alone.  A null text stays null with
    no finds, an empty one empty.  Repeated rows and null ids stay rows of their own; other columns are
    not read; an empty table gives no row.  Nothing is shuffled.
    """
    text = F.col("__text")
    some = F.coalesce(text.rlike(r"\d|@"), F.lit(False))
    hits = F.transform(F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)), lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))
    none = F.array().cast("array<struct<value:string,kind:string>>")
    found = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("__text")).withColumn("__hits", F.when(some, hits).otherwise(none))
    between = F.split(text, ANY, -1)
    new = F.array_join(F.flatten(F.zip_with(between, F.transform("__hits", lambda h: pseudonym(h["value"], h["kind"], key, inverse)), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return found.select(
        F.col("id").alias(id_col),
        F.when(F.size("__hits") > 0, new).otherwise(text).alias("text"),
        *(F.size(F.filter("__hits", _is(k))).cast("bigint").alias(f"n_{k}") for k in PATTERNS),
    )


def _is(kind: str):
    return lambda h: F.coalesce(h["kind"] == kind, F.lit(False))
