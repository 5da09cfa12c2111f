"""Exact fixed-point arithmetic."""

from __future__ import annotations

# Low bits split off so that BIGINT sums of the parts cannot overflow.
_LOW_BITS = 20


def idiv(numerator: str, denominator: str | int) -> str:
    """Integer division, truncating toward zero."""
    return f"(({numerator}) div ({denominator}))"


def key_mod(value: str, size: int) -> str:
    """Key in ``[0, size)``, also for negative ids."""
    return f"cast(pmod({value}, {size}) as int)"


def round_half_away(value: str) -> str:
    """Round a double to BIGINT, halves away from zero.

    Truncation and one exact subtraction; ``round`` on doubles goes through
    a decimal object for every row.
    """
    whole = f"cast({value} as bigint)"
    rest = f"({value} - {whole})"
    return f"({whole} + case when {rest} >= 0.5D then 1 when {rest} <= -0.5D then -1 else 0 end)"


def round_div(value: str, divisor: int) -> str:
    """Exact integer ``value / divisor``, halves away from zero (even divisor)."""
    magnitude = f"((abs({value}) + {divisor // 2}) div cast({divisor} as decimal(20,0)))"
    return f"case when {value} < 0 then -{magnitude} else {magnitude} end"


def wide(value: str) -> str:
    """Integer as DECIMAL(19,0), so that products and sums of it stay exact."""
    return f"cast({value} as decimal(19,0))"


def wide_dot(*terms: tuple[str, str]) -> str:
    """Aggregate: exact sum of ``value * factor`` over all terms and rows.

    Values are split into high and low bits, summed as two BIGINTs and joined
    in DECIMAL once per group. Decimal products per row cost several times
    as much. Holds for values below 2**57 and sums of 32 factors below 2**20;
    beyond that the sum raises.
    """
    high = " + ".join(f"shiftright({value}, {_LOW_BITS}) * ({factor})" for value, factor in terms)
    low = " + ".join(f"({value} & {(1 << _LOW_BITS) - 1}) * ({factor})" for value, factor in terms)
    scale = f"cast({1 << _LOW_BITS} as decimal(7,0))"
    return f"cast({wide(f'sum({high})')} * {scale} + {wide(f'sum({low})')} as decimal(38,0))"
