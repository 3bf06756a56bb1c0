"""Personal data: format-preserving Feistel pseudonyms.

Numbers and dates that validate are permuted by a keyed Feistel network within
their own format, so the same value gets the same pseudonym in every document
and no two values share one:

* card numbers of 13 to 19 digits, unbroken or in the usual groups, with a valid
  Luhn sum: the digits but the last are permuted, the last one is computed anew;
  blanks and hyphens stay.
* IPv4 addresses: the 32 bits are permuted.
* telephone numbers, +country (area) number, unbroken after a plus, (area)
  number-number, and area-number-number with hyphens or dots: the digits after
  the country code are permuted, all other characters stay. (An unbroken number
  keeps its first three digits, where its country code is.)
* dates (yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy) that exist: the day is permuted
  within its 400 years, a whole cycle of the calendar. A date with slashes that
  can only be mm/dd/yyyy stays one: days 13 to 28 are permuted with their month
  and year, later ones keep day and month and permute the year; 02/29 stays.
* mail addresses: two keyed sweeps over the local part, in opposite directions,
  turn each digit into a digit and each letter into one of its case; signs and
  the domain stay; more than 64 characters go in blocks.

Digits permute as numbers of their count, in two halves of known moduli; round
values are SHA-256 of key, kind, length, round and the other half. Where kinds
overlap, the leftmost match counts, the longest kind first. What doesn't
validate stays as it is.

Cases: a null text stays null, an empty one empty; texts of any length are
rewritten whole; repeated rows are rewritten alike; an empty table gives an
empty result; extra columns pass through untouched unless they bear a name of
``RESULT``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.storage import let, unused

RESULT = ("n_cards", "n_addresses", "n_phones", "n_dates", "n_mails")
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
KINDS = {
    # From its first letter on, however long; a run is tried once, as it begins only where no letter stands before.
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "address": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])",
    "phone": (
        r"(?:\+[0-9]{1,3}[ -]?\([0-9]{2,4}\)[ -]?[0-9]{3,4}[ -][0-9]{3,4}|\+[0-9]{1,3}(?:[ -][0-9]{2,4}){2,4}|\+[0-9]{8,15}"
        r"|\([0-9]{3}\) ?[0-9]{3}[-.][0-9]{4}|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}|(?<![0-9.])[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![0-9])"
    ),
    # Unbroken, or in groups of four, or of four, six and five: a number that stands beside it is none of its digits.
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Cheap condition that every match satisfies: a mail sign or two digits near one another.
LIKELY = r"@|[0-9][0-9. /()-]{0,2}[0-9]"


@dataclass(frozen=True)
class Pseudonyms:
    """key: the secret. rounds: of the Feistel network, an even number."""

    key: str
    rounds: int = 8


def feistel(value: Column, left: Column, right: Column, size: Column, kind: str, config: Pseudonyms, back: bool = False) -> Column:
    """Permute value, a number below left * right, by adding round values to its halves in turn."""
    order = range(config.rounds)
    # Integer division: a double would lose digits.
    state = F.struct(F.call_function("div", value, right).alias("a"), F.pmod(value, right).alias("b"))
    moves = F.array(*[F.lit(i) for i in (reversed(order) if back else order)])
    sign = -1 if back else 1

    def step(s: Column, i: Column) -> Column:
        seed = lambda half: _keyed(config, kind, size, i, half)
        even = F.pmod(i, F.lit(2)) == 0
        a = F.when(even, F.pmod(s["a"] + sign * F.pmod(seed(s["b"]), left), left)).otherwise(s["a"])
        b = F.when(even, s["b"]).otherwise(F.pmod(s["b"] + sign * F.pmod(seed(s["a"]), right), right))
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(moves, state, step, lambda s: s["a"] * right + s["b"])


def _keyed(config: Pseudonyms, kind: str, size: Column, number: Column, half: Column) -> Column:
    """A pseudorandom number below 2^52 from the key, the format, the round and one half."""
    seed = F.concat_ws("|", F.lit(config.key), F.lit(kind), size.cast("string"), number.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(seed, 256), 1, 13), 16, 10).cast("bigint")


def permute_digits(digits: Column, kind: str, config: Pseudonyms, back: bool = False) -> Column:
    """A string of 2 to 18 digits, permuted among those of its length."""
    n = F.length(digits)
    right_n = F.call_function("div", n, F.lit(2)).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("bigint")
    moved = feistel(digits.cast("bigint"), power(n - right_n), power(right_n), n, kind, config, back)
    return F.lpad(moved.cast("string"), n, "0")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum of digits; those at an odd (doubled 0) or even place from the right count twice."""
    places = F.reverse(F.filter(F.split(digits, ""), lambda d: d != ""))
    weigh = lambda d, i: F.when(F.pmod(i, F.lit(2)) == doubled, F.when(d < 5, 2 * d).otherwise(2 * d - 9)).otherwise(d)
    return F.aggregate(F.transform(places, lambda d, i: weigh(d.cast("int"), i)), F.lit(0), lambda a, x: a + x)


def _refill(shape: Column, digits: Column) -> Column:
    """Put digits, in order, where shape has digits."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("used"))

    def step(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(
            F.concat(s["done"], F.when(digit, F.substring(digits, s["used"] + 1, F.lit(1))).otherwise(c)).alias("done"),
            (s["used"] + digit.cast("int")).alias("used"),
        )

    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), start, step, lambda s: s["done"])


def _card(found: Column, config: Pseudonyms) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")

    def renew(d: Column) -> Column:
        body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), "card", config)
        check = lambda b: F.concat(b, F.pmod(-_luhn_sum(b, 0), F.lit(10)).cast("string"))
        return F.when(F.pmod(_luhn_sum(d, 1), F.lit(10)) == 0, _refill(found, let(body, check)))

    return let(digits, renew)


def _address(found: Column, config: Pseudonyms) -> Column:
    parts = F.split(found, r"\.").cast("array<bigint>")
    value = let(parts, lambda p: ((p[0] * 256 + p[1]) * 256 + p[2]) * 256 + p[3])
    half = F.lit(65536).cast("bigint")
    moved = feistel(value, half, half, F.lit(32), "address", config)
    octet = lambda v, k: F.pmod(F.shiftrightunsigned(v, 8 * k), F.lit(256))
    return let(moved, lambda v: F.concat_ws(".", *[octet(v, k).cast("string") for k in (3, 2, 1, 0)]))


def _date(found: Column, config: Pseudonyms) -> Column:
    iso = found.rlike("^[0-9]{4}-")
    slash = found.contains("/")
    day = F.when(iso, F.try_to_date(found, "yyyy-MM-dd")).otherwise(
        F.try_to_date(F.translate(found, "/", "."), "dd.MM.yyyy")
    )
    epoch = lambda d: F.make_date(F.call_function("div", F.year(d), F.lit(400)).cast("int") * 400, F.lit(1), F.lit(1))

    def renew(d: Column) -> Column:
        # 146,097 days make 400 years: 189 times 773.
        at = F.datediff(d, epoch(d)).cast("bigint")
        moved = feistel(at, F.lit(189).cast("bigint"), F.lit(773).cast("bigint"), F.lit(400), "date", config)
        new = F.date_add(epoch(d), moved.cast("int"))
        text = F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(slash, F.date_format(new, "dd/MM/yyyy"))
        return text.otherwise(F.date_format(new, "dd.MM.yyyy"))

    return let(day, lambda d: F.when(d.isNotNull(), renew(d)).when(slash, _month_first(found, config)))


def _month_first(found: Column, config: Pseudonyms) -> Column:
    """A date that can only be mm/dd/yyyy, as another such date; null if it isn't one."""
    month, day, year = (F.get(F.split(found, "/"), F.lit(i)).cast("bigint") for i in range(3))
    of_400, cycle = F.pmod(year, F.lit(400)), F.call_function("div", year, F.lit(400)) * 400
    number = lambda n: F.lit(n).cast("bigint")
    two = lambda n, k: F.lpad(n.cast("string"), k, "0")

    def written(m: Column, d: Column, y: Column) -> Column:
        return F.concat_ws("/", two(m, 2), two(d, 2), two(y, 4))

    # 400 years of 12 months of 16 days are 240 times 320.
    place = (of_400 * 12 + month - 1) * 16 + day - 13
    moved = feistel(place, number(240), number(320), F.lit(16), "date", config)
    any_day = let(moved, lambda v: written(F.pmod(F.call_function("div", v, F.lit(16)), F.lit(12)) + 1, F.pmod(v, F.lit(16)) + 13, cycle + F.call_function("div", v, F.lit(192))))
    late = let(feistel(of_400, number(20), number(20), day, "date", config), lambda y: written(month, day, cycle + y))
    exists = F.try_to_date(found, "MM/dd/yyyy").isNotNull()
    return F.when(exists & (day > 28), F.when(month == 2, found).otherwise(late)).when(exists & (day > 12), any_day)


def _phone(found: Column, config: Pseudonyms) -> Column:
    """The country code, up to the first separator after a plus, stays."""
    code = F.regexp_extract(found, r"^\+[0-9]{1,3}[ -]?", 0)
    rest = F.substring(found, F.length(code) + 1, F.length(found))
    digits = F.regexp_replace(rest, "[^0-9]", "")
    return F.concat(code, _refill(rest, permute_digits(digits, "phone", config)))


def _mail(found: Column, config: Pseudonyms) -> Column:
    """The local part, in blocks of 64 characters at most, each character shifted by a key drawn from all others of its block; the steps can be undone."""
    local = F.substring_index(found, "@", 1)
    radix = lambda c: F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1)
    digit = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).when(c.rlike("[a-z]"), F.ascii(c) - 97).when(c.rlike("[A-Z]"), F.ascii(c) - 65).otherwise(0)
    shape = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")

    def moved(block: Column) -> Column:
        # Every character but the first is shifted by a key drawn from those before it, and back again:
        # two passes in opposite directions let each character depend on all others.
        def sweep(xs: Column, salt: str, shapes: Column) -> Column:
            def step(s: Column, c: Column) -> Column:
                key = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{config.key}|mail|{salt}|"), shapes, F.lit("|"), s), 256), 1, 8), 16, 10).cast("bigint")
                value = F.pmod(digit(c) + F.pmod(key, radix(c).cast("bigint")), radix(c).cast("bigint"))
                base = F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65)
                return F.concat(s, F.when(base.isNotNull(), F.char(base + value)).otherwise(c))

            return F.aggregate(xs, F.lit(""), step)

        def both(shapes: Column) -> Column:
            return F.reverse(sweep(F.reverse(chars(sweep(chars(block), "0", shapes))), "1", shapes))

        return let(shape(block), both)

    blocks = F.regexp_extract_all(local, F.lit(".{1,64}"), F.lit(0))
    return F.concat(F.array_join(F.transform(blocks, moved), ""), F.substring(found, F.length(local) + 1, F.length(found)))


def pseudonymize(docs: DataFrame, config: Pseudonyms, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in the text and, per kind, how many values were replaced."""
    body = F.col(text)
    # (kind, its pseudonym): the kinds in the order in which an overlap is decided.
    makers = {"card": _card, "address": _address, "phone": _phone, "date": _date, "mail": _mail}

    def one(found: Column) -> Column:
        kind = F.lit(None).cast("string")
        new = F.lit(None).cast("string")
        for name in reversed(list(KINDS)):
            is_it = found.rlike(f"^(?:{KINDS[name]})$")
            kind = F.when(is_it, F.lit(name)).otherwise(kind)
            new = F.when(is_it, makers[name](found, config)).otherwise(new)
        return F.struct(kind.alias("kind"), new.alias("new"), found.alias("old"))

    found = F.transform(F.regexp_extract_all(body, F.lit(ANY), F.lit(0)), one)
    none = F.array().cast("array<struct<kind:string,new:string,old:string>>")
    kept = [c for c in docs.columns if c not in RESULT]
    spot = unused(docs, "found")
    # The filter is cheap; most texts end there.
    marked = docs.select(*kept, F.when(body.rlike(LIKELY), found).otherwise(none).alias(spot))

    def rebuilt(pieces: Column) -> Column:
        words = F.transform(F.col(spot), lambda x: F.coalesce(x["new"], x["old"]))
        joined = F.zip_with(pieces, words, lambda p, w: F.concat(F.coalesce(p, F.lit("")), F.coalesce(w, F.lit(""))))
        return F.array_join(joined, "")

    new = F.when(F.size(spot) > 0, let(F.split(body, ANY, -1), rebuilt)).otherwise(body)
    count = lambda k: F.size(F.filter(spot, lambda x: (x["kind"] == k) & x["new"].isNotNull())).cast("long")
    counts = [count(k).alias(n) for k, n in zip(makers, RESULT)]
    return marked.select(*[new.alias(c) if c == text else F.col(c) for c in kept], *counts)
