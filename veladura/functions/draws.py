"""Counter-based draws: every random value is a function of (seed, column, row id).

A draw is a 32-bit integer held in a bigint. It depends only on its key and the
64-bit row id, so a generated table is the same for any partitioning, a lost
task recomputes the same rows, and any engine with bigint arithmetic can check
the result. All steps stay below 2**63, so ANSI mode never overflows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
MULTIPLIER_A = 0x7FEB352D
MULTIPLIER_B = 0x5BD1E995
DEFAULT_SEED = 42


def key32(*parts: object) -> int:
    """Plan-time constant for one draw key."""
    text = "|".join(str(p) for p in parts)
    return int.from_bytes(hashlib.md5(text.encode("utf-8")).digest()[:4], "big")


def scramble(x: str) -> str:
    """SQL text of a bijection on 32-bit integers (two multiplications, three xor-shifts)."""
    for shift, multiplier in ((16, MULTIPLIER_A), (15, MULTIPLIER_B)):
        x = f"((({x} ^ shiftright({x}, {shift})) * {multiplier}L) & {MASK32}L)"
    return f"({x} ^ shiftright({x}, 16))"


class DrawPlan:
    """Collects the draws a projection needs and adds them in two projections.

    Each draw scrambles the low half of the row id with its key, then the result
    with the high half, so ids beyond 2**32 do not repeat. The two steps are
    separate projections because each step mentions its input several times.
    """

    def __init__(self, seed: int = DEFAULT_SEED):
        self.seed = seed
        self.keys: dict[int, str] = {}
        self.columns: dict[int, Column] = {}

    def draw(self, column: str, k: int = 0) -> Column:
        key = key32(self.seed, column, k)
        if key not in self.keys:
            self.keys[key] = f"__draw{len(self.keys)}"
            self.columns[key] = F.col(self.keys[key])
        return self.columns[key]

    def apply(self, df: DataFrame, row_id: str | Column) -> DataFrame:
        ident = F.col(row_id) if isinstance(row_id, str) else row_id
        if not self.keys:
            return df
        df = df.withColumns(
            {
                "__low": ident.cast("bigint").bitwiseAND(F.lit(MASK32)),
                "__high": F.shiftrightunsigned(ident.cast("bigint"), 32),
            }
        )
        df = df.selectExpr("*", *[f"{scramble(f'(__low ^ {key}L)')} AS {name}" for key, name in self.keys.items()])
        kept = [f"`{c}`" for c in df.columns if not c.startswith("__draw")]
        return df.selectExpr(*kept, *[f"{scramble(f'({name} ^ __high)')} AS {name}" for name in self.keys.values()])


def below(draw: Column, n: int) -> Column:
    """Integer in [0, n) from a draw; n may be up to 2**31."""
    if not 0 < n <= 1 << 31:
        raise ValueError(f"range of a draw must be in 1..2**31, got {n}")
    return F.shiftright(draw * F.lit(n), 32)


def value_digest(value: Column, salt: str) -> Column:
    """Hex digest that keys a pseudonym by the value it replaces."""
    return F.sha2(F.concat(F.lit(f"{salt}|"), value), 256)


def digest_byte(digest: Column, i: int | Column) -> Column:
    """Byte i (0-based) of a hex digest as an integer."""
    if isinstance(i, int):
        piece = F.substring(digest, 2 * i + 1, 2)
    else:
        piece = digest.substr((i * 2 + 1).cast("int"), F.lit(2))
    return F.conv(piece, 16, 10).cast("int")
