"""Fixed-point DFT twiddle factors, scaled by 1e6.

The factor for ``(k, x)`` depends only on ``k * x mod n``, so a literal array
of ``n`` entries replaces the n-by-n table and no join is needed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

SCALE = 1_000_000


def cos_factor(k: str, x: str, n: int) -> str:
    return _factor(math.cos, k, x, n)


def sin_factor(k: str, x: str, n: int) -> str:
    return _factor(math.sin, k, x, n)


def _factor(wave: Callable[[float], float], k: str, x: str, n: int) -> str:
    table = ", ".join(f"{round(wave(2 * math.pi * j / n) * SCALE)}L" for j in range(n))
    return f"get(array({table}), pmod({k} * {x}, {n}))"
