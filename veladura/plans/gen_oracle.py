"""Oracle SQL for generated columns: the draws and value families in DuckDB's dialect."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence

from veladura.functions import pools
from veladura.functions.draws import DEFAULT_SEED, MASK32, MULTIPLIER_A, MULTIPLIER_B, key32
from veladura.functions.families import ALPHANUMERIC, AS_OF_DAY, EPOCH, LETTERS, LOWER, UPPER, Provider, one_type
from veladura.operators.catalogue import BASE, resolve


def scramble(x: str) -> str:
    x = f"xor({x}, {x} >> 16)"
    x = f"(({x} * {MULTIPLIER_A}) & {MASK32})"
    x = f"xor({x}, {x} >> 15)"
    x = f"(({x} * {MULTIPLIER_B}) & {MASK32})"
    return f"xor({x}, {x} >> 16)"


def quoted(value) -> str:
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{value}::DOUBLE" if isinstance(value, float) else str(value)
    return "'" + str(value).replace("'", "''") + "'"


def below(d: str, n: int) -> str:
    return f"(({d} * {n}) >> 32)"


def pick(d: str, pool: Sequence) -> str:
    return f"list_extract([{', '.join(quoted(v) for v in pool)}], ({below(d, len(pool))} + 1)::INT)"


def digit_run(d, n: int, k: int) -> tuple[str, int]:
    parts = []
    while n > 0:
        size = min(n, 9)
        parts.append(f"lpad({below(d(k), 10**size)}::VARCHAR, {size}, '0')")
        n, k = n - size, k + 1
    return " || ".join(parts), k


def letter_run(d, n: int, k: int, alphabet: str) -> tuple[str, int]:
    size, parts = len(alphabet), []
    while n > 0:
        m = min(n, 5)
        for j in range(m):
            parts.append(f"substr({quoted(alphabet)}, ({below(d(k), size**m)} // {size**j} % {size} + 1)::INT, 1)")
        n, k = n - m, k + 1
    return " || ".join(parts), k


def hex_run(d, n: int, k: int = 0) -> str:
    return "(" + " || ".join(f"lpad(lower(to_hex({d(k + i)})), 8, '0')" for i in range(n)) + ")"


def integer(d, low, high) -> str:
    return f"({below(d(0), int(high) - int(low) + 1)} + {int(low)})::INT"


def decimal(d, low, high, scale) -> str:
    unit = 10 ** int(scale)
    first, last = round(float(low) * unit), round(float(high) * unit)
    return f"(({below(d(0), last - first + 1)} + {first})::DOUBLE / {float(unit)}::DOUBLE)"


def template(d, pattern: str) -> str:
    parts, k = [], 0
    for run in re.findall(r"#+|\?+|[^#?]+", pattern):
        if run[0] == "#":
            part, k = digit_run(d, len(run), k)
        elif run[0] == "?":
            part, k = letter_run(d, len(run), k, LETTERS)
        else:
            part = quoted(run)
        parts.append(part)
    return " || ".join(parts)


def composite(d, *parts) -> str:
    return " || ".join(
        f"({build(p, lambda k, b=i: d(1000 * (b + 1) + k))})::VARCHAR" if isinstance(p, Provider) else quoted(str(p))
        for i, p in enumerate(parts)
    )


def uuid4(d) -> str:
    h = hex_run(d, 4)
    return (
        f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-' || "
        f"substr('89ab', ({below(d(4), 4)} + 1)::INT, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
    )


def user_name(d) -> str:
    return f"{pick(d(0), pools.MAIL_FIRST)} || '.' || {pick(d(1), pools.MAIL_LAST)} || {digit_run(d, 3, 2)[0]}"


def street(d) -> str:
    return f"{pick(d(0), pools.STREET_KINDS)} || ' ' || {pick(d(1), pools.LAST_NAMES)}"


def birth(d, k: int) -> str:
    first = (dt.date(1950, 1, 1) - EPOCH).days
    return f"strftime(DATE '1970-01-01' + ({below(d(k), 21915)} + {first})::INT, '%y%m%d')"


def curp(d) -> str:
    middle, k = letter_run(d, 6, 2, UPPER)
    return f"{letter_run(d, 4, 0, UPPER)[0]} || {birth(d, 1)} || {middle} || {digit_run(d, 2, k)[0]}"


def plate(d) -> str:
    letters, k = letter_run(d, 3, 0, UPPER)
    return f"{letters} || '-' || {digit_run(d, 3, k)[0]}"


def card(d) -> str:
    payload = f"'4' || lpad({below(d(0), 10**7)}::VARCHAR, 7, '0') || lpad({below(d(1), 10**7)}::VARCHAR, 7, '0')"
    total = " + ".join(
        f"CASE WHEN {int(i % 2 == 0)} = 1 THEN (2 * x{i}) // 10 + (2 * x{i}) % 10 ELSE x{i} END".replace(f"x{i}", f"substr({payload}, {i + 1}, 1)::INT")
        for i in range(15)
    )
    return f"{payload} || ((10 - ({total}) % 10) % 10)::VARCHAR"


def iban(d) -> str:
    body = digit_run(d, 18, 0)[0]
    return f"'MX' || lpad((98 - (({body} || '223300')::HUGEINT % 97))::VARCHAR, 2, '0') || {body}"


def password(d) -> str:
    return (
        f"{letter_run(d, 4, 1, LOWER)[0]} || {letter_run(d, 2, 2, UPPER)[0]} || "
        f"substr('!@#$%&*_', ({below(d(0), 8)} + 1)::INT, 1) || {digit_run(d, 3, 3)[0]}"
    )


def date_between(d, first, last) -> str:
    return f"(DATE '1970-01-01' + ({below(d(0), int(last) - int(first) + 1)} + {AS_OF_DAY + int(first)})::INT)"


def clock(d) -> str:
    return " || ':' || ".join(f"lpad({below(d(k), n)}::VARCHAR, 2, '0')" for n, k in ((24, 0), (60, 1), (60, 2)))


def initcap(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || substr({x}, 2))"


def text(d, sentences=1, words=6) -> str:
    parts, k = [], 0
    for _ in range(sentences):
        low, high = max(1, words - 2), words + 2
        pool = f"[{', '.join(quoted(w) for w in pools.WORDS)}]"
        picks = [f"list_extract({pool}, ((({d(k + 1 + i // 5)} >> {6 * (i % 5)}) & 63) + 1)::INT)" for i in range(high)]
        picks[0] = initcap(picks[0])
        parts.append(f"array_to_string([{', '.join(picks)}][1:({below(d(k), high - low + 1)} + {low})::INT], ' ') || '.'")
        k += 1 - (-high // 5)
    return " || ' ' || ".join(parts)


FAMILIES = {
    "choice": lambda d, *pool: pick(d(0), one_type(pool)),
    "int_uniform": integer,
    "int_text": lambda d, a, b: f"{integer(d, a, b)}::VARCHAR",
    "float_uniform": decimal,
    "boolean": lambda d, as_int=False: f"{below(d(0), 2)}::INT" if as_int else f"({below(d(0), 2)} = 1)",
    "const": lambda d, value: quoted(value),
    "digits": lambda d, n: digit_run(d, int(n), 0)[0],
    "template": template,
    "concat": composite,
    "hex_color": lambda d: f"'#' || lpad(to_hex({below(d(0), 1 << 24)}), 6, '0')",
    "uuid4": uuid4,
    "token": lambda d, n: hex_run(d, int(n) // 8),
    "ipv4": lambda d: f"concat_ws('.', {', '.join(f'(({d(0)} >> {s}) & 255)' for s in (24, 16, 8, 0))})",
    "ipv6": lambda d: f"concat_ws(':', {', '.join(f'substr({hex_run(d, 4)}, {4 * i + 1}, 4)' for i in range(8))})",
    "mac": lambda d: f"concat_ws(':', {', '.join(f'substr({hex_run(d, 2)}, {2 * i + 1}, 2)' for i in range(6))})",
    "first_name": lambda d: pick(d(0), pools.FIRST_NAMES),
    "last_name": lambda d: pick(d(1), pools.LAST_NAMES),
    "person_name": lambda d: f"{pick(d(0), pools.FIRST_NAMES)} || ' ' || {pick(d(1), pools.LAST_NAMES)} || ' ' || {pick(d(2), pools.LAST_NAMES)}",
    "user_name": user_name,
    "email": lambda d: f"{user_name(d)} || '@' || {pick(d(3), pools.MAIL_DOMAINS)}",
    "company_email": lambda d: f"{user_name(d)} || '@' || {pick(d(3), pools.MAIL_LAST)} || '.example.com'",
    "phone": lambda d: f"{pick(d(0), ['55', '56', '33', '81', '44', '66', '99', '77', '22'])} || ' ' || {digit_run(d, 4, 1)[0]} || ' ' || {digit_run(d, 4, 2)[0]}",
    "city": lambda d: pick(d(0), pools.CITIES),
    "state": lambda d: pick(d(0), pools.STATES),
    "country": lambda d: pick(d(0), pools.COUNTRIES),
    "postcode": lambda d: digit_run(d, 5, 0)[0],
    "street": street,
    "city_suffix": lambda d: pick(d(0), pools.CITY_SUFFIXES),
    "address": lambda d: f"{street(d)} || ' ' || ({below(d(2), 999)} + 1)::VARCHAR || ', ' || {pick(d(3), pools.CITIES)} || ', ' || {pick(d(4), pools.STATES)}",
    "company": lambda d: f"{pick(d(0), pools.LAST_NAMES)} || ' ' || {pick(d(1), pools.COMPANY_SUFFIXES)}",
    "job": lambda d: pick(d(0), pools.JOBS),
    "color": lambda d: pick(d(0), pools.COLOURS),
    "language": lambda d: pick(d(0), pools.LANGUAGES),
    "plate": plate,
    "rfc": lambda d: f"{letter_run(d, 4, 0, UPPER)[0]} || {birth(d, 1)} || {letter_run(d, 3, 2, ALPHANUMERIC)[0]}",
    "curp": curp,
    "ssn": lambda d: digit_run(d, 11, 0)[0],
    "card": card,
    "iban": iban,
    "swift": lambda d: f"{letter_run(d, 4, 0, UPPER)[0]} || 'MX' || {letter_run(d, 2, 1, ALPHANUMERIC)[0]}",
    "domain": lambda d: f"{pick(d(0), pools.MAIL_LAST)} || '.' || {pick(d(1), pools.TOP_LEVELS)}",
    "url": lambda d: f"'https://www.' || {pick(d(0), pools.MAIL_LAST)} || '.' || {pick(d(1), pools.TOP_LEVELS)} || '/'",
    "user_agent": lambda d: pick(d(0), pools.AGENTS),
    "password": password,
    "date_between": date_between,
    "date_text": lambda d: f"{date_between(d, -AS_OF_DAY, 0)}::VARCHAR",
    "datetime_past": lambda d: f"(TIMESTAMP '1970-01-01' + to_seconds({below(d(0), AS_OF_DAY * 86400)}))",
    "time_text": clock,
    "word": lambda d: pick(d(0), pools.WORDS),
    "capital_word": lambda d: initcap(pick(d(0), pools.WORDS)),
    "text": text,
}


def build(provider: Provider, d) -> str:
    return FAMILIES[provider.family](d, *provider.args)


def generated(
    rows: str, row_id: str, columns: Sequence[str] | Mapping[str, Provider], keep: Sequence[str] = (), seed: int = DEFAULT_SEED,
    catalogue: Mapping[str, Provider] = BASE,
) -> str:
    """Generated columns over a row source: one CTE per half of the draw, then the values."""
    names: dict[int, str] = {}

    def draw(column: str):
        return lambda k: names.setdefault(key32(seed, column, k), f"draw{len(names)}")

    providers = columns if isinstance(columns, Mapping) else {c: resolve(c, catalogue) for c in columns}
    values = [f'{build(p, draw(c))} AS "{c}"' for c, p in providers.items()]
    kept = "".join(f", {c}" for c in keep)
    first = "".join(f", {scramble(f'xor(low, {key})')} AS {name}" for key, name in names.items())
    second = "".join(f", {scramble(f'xor({name}, high)')} AS {name}" for name in names.values())
    return f"""SELECT {', '.join([*keep, *values])} FROM (SELECT low{kept}{second} FROM (SELECT low, high{kept}{first} FROM
      (SELECT ({row_id}) & {MASK32} AS low, (({row_id}) >> 32) & {MASK32} AS high{kept} FROM ({rows}))))"""
