"""Value families: a provider is (family, args); a family turns draws into a column.

``d(k)`` is the k-th draw of the column being generated. Everything is built-in
arithmetic and string functions on draws, so no Python runs in the tasks.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from veladura.functions import pools
from veladura.functions.draws import below

Draw = Callable[[int], Column]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
LETTERS = LOWER + UPPER
RFC_LETTERS = UPPER + "Ñ&"
ALPHANUMERIC = UPPER + DIGITS

# "Today" for the date families unless a caller names another day: generated data must not change from day to day.
AS_OF = dt.date(2025, 1, 1)
EPOCH = dt.date(1970, 1, 1)
AS_OF_DAY = (AS_OF - EPOCH).days


class Provider(NamedTuple):
    family: str
    args: tuple = ()


def sql_literal(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value) if -(1 << 31) <= value < 1 << 31 else f"{value}L"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def pool_array(pool: Sequence) -> Column:
    """Literal array, parsed once instead of built value by value through the gateway."""
    return F.expr(f"array({', '.join(sql_literal(v) for v in pool)})")


def pick(draw: Column, pool: Sequence) -> Column:
    """Uniform choice from a literal pool."""
    return F.element_at(pool_array(pool), (below(draw, len(pool)) + 1).cast("int"))


def one_type(pool: Sequence) -> list:
    """One type for the whole pool: numbers stay numbers, mixtures become text."""
    pool = list(pool)
    if not pool:
        raise ValueError("a choice needs at least one value")
    kinds = {type(v) for v in pool}
    if kinds == {int, float}:
        return [float(v) for v in pool]
    return pool if len(kinds) == 1 else [str(v) for v in pool]


def joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def digit_run(d: Draw, n: int, k: int) -> tuple[Column, int]:
    """n decimal digits from draw k on, nine per draw; returns (text, next draw)."""
    parts = []
    while n > 0:
        size = min(n, 9)
        parts.append(F.lpad(below(d(k), 10**size).cast("string"), size, "0"))
        n, k = n - size, k + 1
    return joined(parts), k


def letter_run(d: Draw, n: int, k: int, alphabet: str) -> tuple[Column, int]:
    """n letters of an alphabet from draw k on, five per draw; returns (text, next draw)."""
    size, parts = len(alphabet), []
    while n > 0:
        m = min(n, 5)
        v = below(d(k), size**m)
        for j in range(m):
            index = F.floor(v / F.lit(float(size**j))) % F.lit(size)
            parts.append(F.lit(alphabet).substr((index + 1).cast("int"), F.lit(1)))
        n, k = n - m, k + 1
    return joined(parts), k


def hex_run(d: Draw, draws: int, k: int = 0) -> Column:
    """Eight lower-case hex digits per draw."""
    return joined([F.lower(F.lpad(F.hex(d(k + i)), 8, "0")) for i in range(draws)])


# --- numbers, choices, booleans -------------------------------------------------


def choice(d: Draw, *pool) -> Column:
    return pick(d(0), one_type(pool))


def int_uniform(d: Draw, low: int, high: int) -> Column:
    low, high = int(low), int(high)
    value = below(d(0), high - low + 1) + F.lit(low).cast("bigint")
    return value.cast("int") if -(1 << 31) <= low and high < 1 << 31 else value


def int_text(d: Draw, low: int, high: int) -> Column:
    return int_uniform(d, low, high).cast("string")


def float_uniform(d: Draw, low: float, high: float, scale: int) -> Column:
    """Uniform on the grid of the wanted decimals, so there is nothing left to round."""
    unit = 10 ** int(scale)
    first, last = round(float(low) * unit), round(float(high) * unit)
    return (below(d(0), last - first + 1) + F.lit(first).cast("bigint")) / F.lit(float(unit))


def boolean(d: Draw, as_int: bool = False) -> Column:
    value = below(d(0), 2)
    return value.cast("int") if as_int else value == 1


def const(d: Draw, value) -> Column:
    return F.lit(value)


# --- patterned text ------------------------------------------------------------


def digits(d: Draw, n: int) -> Column:
    return digit_run(d, int(n), 0)[0]


def template(d: Draw, pattern: str) -> Column:
    """``?`` is a letter, ``#`` a digit, anything else stands for itself."""
    parts, k = [], 0
    for run in re.findall(r"#+|\?+|[^#?]+", pattern):
        if run[0] == "#":
            part, k = digit_run(d, len(run), k)
        elif run[0] == "?":
            part, k = letter_run(d, len(run), k, LETTERS)
        else:
            part = F.lit(run)
        parts.append(part)
    return joined(parts)


def concat(d: Draw, *parts, as_of: int = AS_OF_DAY) -> Column:
    """Composite value; nested providers get their own block of draws."""
    columns = [
        build(p, lambda k, block=i: d(1000 * (block + 1) + k), as_of).cast("string") if isinstance(p, Provider) else F.lit(str(p))
        for i, p in enumerate(parts)
    ]
    return joined(columns)


def hex_color(d: Draw) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.hex(below(d(0), 1 << 24)), 6, "0"))


def uuid4(d: Draw) -> Column:
    h = hex_run(d, 4)
    variant = F.lit("89ab").substr((below(d(4), 4) + 1).cast("int"), F.lit(1))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def token(d: Draw, length: int) -> Column:
    """Hex token: 32 characters as an MD5, 40 as a SHA-1."""
    return hex_run(d, int(length) // 8)


def ipv4(d: Draw) -> Column:
    octets = [F.shiftright(d(0), s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def ipv6(d: Draw) -> Column:
    h = hex_run(d, 4)
    return F.concat_ws(":", *[F.substring(h, 4 * i + 1, 4) for i in range(8)])


def mac(d: Draw) -> Column:
    h = hex_run(d, 2)
    return F.concat_ws(":", *[F.substring(h, 2 * i + 1, 2) for i in range(6)])


# --- people, places, companies -------------------------------------------------


def first_name(d: Draw) -> Column:
    return pick(d(0), pools.FIRST_NAMES)


def last_name(d: Draw) -> Column:
    return pick(d(1), pools.LAST_NAMES)


def person_name(d: Draw) -> Column:
    return F.concat_ws(" ", first_name(d), last_name(d), pick(d(2), pools.LAST_NAMES))


def user_name(d: Draw) -> Column:
    return F.concat(pick(d(0), pools.MAIL_FIRST), F.lit("."), pick(d(1), pools.MAIL_LAST), digit_run(d, 3, 2)[0])


def email(d: Draw) -> Column:
    return F.concat(user_name(d), F.lit("@"), pick(d(3), pools.MAIL_DOMAINS))


def company_email(d: Draw) -> Column:
    return F.concat(user_name(d), F.lit("@"), pick(d(3), pools.MAIL_LAST), F.lit(".example.com"))


def phone(d: Draw) -> Column:
    # Area codes the mobile rule knows, so generated numbers look like numbers to the detector.
    area = pick(d(0), ["55", "56", "33", "81", "44", "66", "99", "77", "22"])
    return F.concat(area, F.lit(" "), digit_run(d, 4, 1)[0], F.lit(" "), digit_run(d, 4, 2)[0])


def city(d: Draw) -> Column:
    return pick(d(0), pools.CITIES)


def state(d: Draw) -> Column:
    return pick(d(0), pools.STATES)


def country(d: Draw) -> Column:
    return pick(d(0), pools.COUNTRIES)


def postcode(d: Draw) -> Column:
    return digits(d, 5)


def street(d: Draw) -> Column:
    return F.concat_ws(" ", pick(d(0), pools.STREET_KINDS), pick(d(1), pools.LAST_NAMES))


def city_suffix(d: Draw) -> Column:
    return pick(d(0), pools.CITY_SUFFIXES)


def address(d: Draw) -> Column:
    number = (below(d(2), 999) + 1).cast("string")
    return F.concat(
        street(d), F.lit(" "), number, F.lit(", "), pick(d(3), pools.CITIES), F.lit(", "), pick(d(4), pools.STATES)
    )


def company(d: Draw) -> Column:
    return F.concat_ws(" ", pick(d(0), pools.LAST_NAMES), pick(d(1), pools.COMPANY_SUFFIXES))


def job(d: Draw) -> Column:
    return pick(d(0), pools.JOBS)


def color(d: Draw) -> Column:
    return pick(d(0), pools.COLOURS)


def language(d: Draw) -> Column:
    return pick(d(0), pools.LANGUAGES)


def plate(d: Draw) -> Column:
    letters, k = letter_run(d, 3, 0, UPPER)
    return F.concat(letters, F.lit("-"), digit_run(d, 3, k)[0])


# --- identity and bank numbers -------------------------------------------------


def birth_digits(d: Draw, k: int) -> Column:
    """yymmdd of a valid day between 1950 and 2009."""
    first = (dt.date(1950, 1, 1) - EPOCH).days
    day = F.date_from_unix_date((below(d(k), 21915) + F.lit(first)).cast("int"))
    return F.date_format(day, "yyMMdd")


def rfc(d: Draw) -> Column:
    tail, _ = letter_run(d, 3, 2, ALPHANUMERIC)
    return F.concat(letter_run(d, 4, 0, UPPER)[0], birth_digits(d, 1), tail)


def curp(d: Draw) -> Column:
    middle, k = letter_run(d, 6, 2, UPPER)
    return F.concat(letter_run(d, 4, 0, UPPER)[0], birth_digits(d, 1), middle, digit_run(d, 2, k)[0])


def ssn(d: Draw) -> Column:
    return digits(d, 11)


def card(d: Draw) -> Column:
    """Sixteen digits starting with 4; the last one is the Luhn check digit."""
    high, low = below(d(0), 10**7), below(d(1), 10**7)

    def digit(v: Column, j: int) -> Column:
        return F.floor(v / F.lit(float(10**j))) % F.lit(10)

    # Payload 4 hhhhhhh lllllll; positions 0, 2, 4 ... from the left are doubled.
    payload = [digit(high, 6 - i) for i in range(7)] + [digit(low, 6 - i) for i in range(7)]
    total = F.lit(8)
    for i, x in enumerate(payload, start=1):
        total = total + (x if i % 2 else F.when(x >= 5, x * 2 - 9).otherwise(x * 2))
    check = (F.lit(10) - total % 10) % 10
    return F.concat(
        F.lit("4"), F.lpad(high.cast("string"), 7, "0"), F.lpad(low.cast("string"), 7, "0"), check.cast("string")
    )


def iban(d: Draw) -> Column:
    """MX + two check digits (mod 97) + eighteen digits."""
    body, _ = digit_run(d, 18, 0)
    remainder = F.concat(body, F.lit("223300")).cast("decimal(38,0)") % F.lit(97).cast("decimal(38,0)")
    check = F.lpad((F.lit(98) - remainder.cast("int")).cast("string"), 2, "0")
    return F.concat(F.lit("MX"), check, body)


def swift(d: Draw) -> Column:
    return F.concat(letter_run(d, 4, 0, UPPER)[0], F.lit("MX"), letter_run(d, 2, 1, ALPHANUMERIC)[0])


# --- web -----------------------------------------------------------------------


def domain(d: Draw) -> Column:
    return F.concat(pick(d(0), pools.MAIL_LAST), F.lit("."), pick(d(1), pools.TOP_LEVELS))


def url(d: Draw) -> Column:
    return F.concat(F.lit("https://www."), domain(d), F.lit("/"))


def user_agent(d: Draw) -> Column:
    return pick(d(0), pools.AGENTS)


def password(d: Draw) -> Column:
    """Ten characters with at least one upper, lower, digit and sign."""
    sign = F.lit("!@#$%&*_").substr((below(d(0), 8) + 1).cast("int"), F.lit(1))
    return F.concat(
        letter_run(d, 4, 1, LOWER)[0], letter_run(d, 2, 2, UPPER)[0], sign, digit_run(d, 3, 3)[0]
    )


# --- dates ---------------------------------------------------------------------


def date_between(d: Draw, first: int, last: int, as_of: int = AS_OF_DAY) -> Column:
    """Date between two day offsets from a day."""
    return F.date_from_unix_date((below(d(0), int(last) - int(first) + 1) + F.lit(as_of + int(first))).cast("int"))


def date_text(d: Draw, as_of: int = AS_OF_DAY) -> Column:
    """ISO date since 1970 as text."""
    return date_between(d, -as_of, 0, as_of).cast("string")


def datetime_past(d: Draw, as_of: int = AS_OF_DAY) -> Column:
    """Second since 1970, as a zone-free timestamp."""
    seconds = below(d(0), as_of * 86400).cast("decimal(18,6)")
    return F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def time_text(d: Draw) -> Column:
    fields = [(24, 0), (60, 1), (60, 2)]
    return F.concat_ws(":", *[F.lpad(below(d(k), n).cast("string"), 2, "0") for n, k in fields])


# --- words ---------------------------------------------------------------------


def word(d: Draw) -> Column:
    return pick(d(0), pools.WORDS)


def capital_word(d: Draw) -> Column:
    return F.initcap(word(d))


def word_run(d: Draw, n: int, k: int) -> tuple[list[Column], int]:
    """n words from draw k on, five per draw: the pool has 64 words, so a word is six bits."""
    words = pool_array(pools.WORDS)
    picks = [
        F.element_at(words, (F.shiftright(d(k + i // 5), 6 * (i % 5)).bitwiseAND(F.lit(63)) + 1).cast("int")) for i in range(n)
    ]
    return picks, k + -(-n // 5)


def sentence_from(d: Draw, words: int, k: int) -> tuple[Column, int]:
    """Sentence of about ``words`` words (two more or fewer)."""
    low, high = max(1, words - 2), words + 2
    picks, after = word_run(d, high, k + 1)
    picks[0] = F.initcap(picks[0])
    size = (below(d(k), high - low + 1) + low).cast("int")
    return F.concat(F.array_join(F.slice(F.array(*picks), 1, size), " "), F.lit(".")), after


def text(d: Draw, sentences: int = 1, words: int = 6) -> Column:
    parts, k = [], 0
    for _ in range(int(sentences)):
        part, k = sentence_from(d, int(words), k)
        parts.append(part)
    return F.concat_ws(" ", *parts)


FAMILIES: dict[str, Callable[..., Column]] = {
    f.__name__: f
    for f in (
        choice, int_uniform, int_text, float_uniform, boolean, const, digits, template, concat, hex_color, uuid4,
        token, ipv4, ipv6, mac, first_name, last_name, person_name, user_name, email, company_email, phone, city,
        state, country, postcode, street, city_suffix, address, company, job, color, language, plate, rfc, curp,
        ssn, card, iban, swift, domain, url, user_agent, password, date_between, date_text, datetime_past,
        time_text, word, capital_word, text,
    )
}


# Families that ask what day it is, and the one that passes the question on.
DATED = {"date_between", "date_text", "datetime_past", "concat"}


def build(provider: Provider, d: Draw, as_of: int = AS_OF_DAY) -> Column:
    """Column of a provider; as_of: the day, since 1970, that dates are counted from."""
    if provider.family not in FAMILIES:
        raise ValueError(f"unknown family {provider.family!r}; known: {', '.join(FAMILIES)}")
    return FAMILIES[provider.family](d, *provider.args, **({"as_of": as_of} if provider.family in DATED else {}))
