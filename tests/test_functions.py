"""Expression helpers against plain Python over random and awkward values."""

from __future__ import annotations

import hashlib
import json
import math
import random
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

from fringeflow.functions.digest import row_digest
from fringeflow.functions.numeric import idiv, key_mod, round_div, round_half_away, wide_dot
from fringeflow.functions.payload import json_int
from fringeflow.functions.timeslot import timeslot
from fringeflow.functions.twiddle import cos_factor, sin_factor

RANDOM = random.Random(7)
INTS = [0, 1, -1, 7, -7, 2**53 + 1, -(2**53) - 1, *[RANDOM.randint(-(10**15), 10**15) for _ in range(200)]]


def evaluate(spark, values, kind, expression):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r["out"] for r in rows.selectExpr("i", f"{expression} as out").orderBy("i").collect()]


def test_round_half_away(spark):
    values = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.49999999999999994, 4503599627370495.5, 1e15 + 0.5]
    values += [RANDOM.uniform(-1e6, 1e6) for _ in range(200)]
    want = [int(Decimal(v).quantize(Decimal(1), ROUND_HALF_UP)) for v in values]
    assert evaluate(spark, values, "double", round_half_away("v")) == want


def test_round_div(spark):
    want = [int((Decimal(v) / 1000).quantize(Decimal(1), ROUND_HALF_UP)) for v in INTS]
    assert evaluate(spark, INTS, "bigint", round_div("cast(v as decimal(38,0))", 1000)) == want


def test_integer_division_truncates_and_keys_are_not_negative(spark):
    quotients = [abs(v) // 20 * (1 if v > 0 else -1) for v in INTS]
    assert evaluate(spark, INTS, "bigint", idiv("v", 20)) == quotients
    assert evaluate(spark, INTS, "bigint", key_mod("v", 49)) == [v % 49 for v in INTS]


def test_wide_dot_passes_64_bits(spark):
    values = [2**56, 2**56 + 1, -(2**55), 3, 2**56 - 5]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = rows.selectExpr(f"{wide_dot(('v', '1000000L'), ('v', '-3L'))} as out").first()["out"]
    assert int(got) == sum(v * 999_997 for v in values) > 2**63


def test_timeslot_is_floor_of_elapsed_time(spark):
    start = datetime(2024, 1, 1)
    values = [start, start - timedelta(microseconds=1), start + timedelta(seconds=323_999, microseconds=999_999)]
    values += [datetime(1, 1, 1), datetime(9999, 12, 31, 23, 59, 59)]
    values += [start + timedelta(seconds=RANDOM.uniform(-1e8, 1e8)) for _ in range(100)]
    for width in (324_000, 21_600, 7):
        want = [(v - start) // timedelta(seconds=width) for v in values]
        expression = timeslot("v", str(start), width)
        if width == 7:  # slots of the earliest and latest years do not fit an INT
            expression = expression.replace(" as int)", " as bigint)")
        assert evaluate(spark, values, "timestamp_ntz", expression) == want


def test_json_int_equals_parsing(spark):
    values = ['{"k": 12}', '{"k":-3}', ' {"k": 1}', '{"k": 1} ', '{"k": 01}', '{"k": 1, "k2": 2}', '{"a": {"k": 9}, "k": 5}',
              '{"k": 99999999999999999999}', '{"k": null}', '{"k": "x"}', "{}", "", "not json", None]

    def parsed(text):
        try:
            value = json.loads(text)["k"]
        except (TypeError, ValueError, KeyError):
            return None
        return value if isinstance(value, int) and abs(value) < 2**63 else None

    assert evaluate(spark, values, "string", json_int("v", "k")) == [parsed(v) for v in values]


def test_digest_is_md5_prefix(spark):
    want = [int(hashlib.md5(f"{v}|a".encode()).hexdigest()[:8], 16) for v in INTS]
    assert evaluate(spark, INTS, "bigint", row_digest("v", "'a'")) == want


def test_factors_repeat_with_the_grid(spark):
    for function, wave in ((cos_factor, math.cos), (sin_factor, math.sin)):
        got = evaluate(spark, list(range(-16, 48)), "int", function("v", "3", 16))
        assert got == [round(wave(2 * math.pi * 3 * v / 16) * 1_000_000) for v in range(-16, 48)]
