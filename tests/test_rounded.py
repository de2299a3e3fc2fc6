"""Rounded numbers against comparing every mention with every value."""

import random
import re
from decimal import Decimal

from tablescope.functions import rounded

POWERS = {"": 0, "%": 0, "percent": 0, **rounded.UNITS}


def plain(texts, values):
    rows = []
    values = {abs(Decimal(str(v))) for v in values if v is not None}
    for key, text in texts:
        for place, m in enumerate(re.finditer(rounded.ROUNDED_PATTERN, text or "", re.ASCII)):
            number, unit = m[1].replace(",", ""), (m[2] or "").lower()
            shown = len(number.partition(".")[2])
            readable = len(number.replace(".", "")) <= 18 and shown <= (8 if unit in ("%", "percent") else 10)
            n = 0
            for scale in [0, -2] if unit in ("%", "percent") else [0]:
                one = Decimal(10) ** (POWERS[unit] + scale)
                half = Decimal("0.5") * Decimal(10) ** -shown
                n += sum((Decimal(number) - half) * one <= v <= (Decimal(number) + half) * one for v in values) if readable else 0
            rows.append((key, place, m[0], n, n > 0))
    return sorted(rows)


def check(spark, texts, values):
    a = spark.createDataFrame(texts, "id int, body string")
    b = spark.createDataFrame([(v,) for v in values], "x double")
    got = rounded.rounded_numbers(a, "id", "body", b, "x")
    assert sorted((r.id, r.place, r.mention, r.matches, r.supported) for r in got.collect()) == plain(texts, values)
    return got


def test_forms(spark):
    texts = [
        (1, "about 12.5K of 3.2 million, roughly 41 % or 0.4; 41.2 percent"), (2, "12,549 and 12,550 and 1 billion"), (3, None), (4, "none"),
        (5, "0 and 0.0 and 0.5 and 1"), (6, "1234567890123456789012 and 1.12345678901 and 5m 5 mm 7B"), (7, "100% 1,000K"),
    ]
    values = [12549.0, 12550.0, 12450.0, 3249999.99, 3250000.0, 0.4123, 41.23, 0.5, -12500.0, 999999999.0, 0.0, 0.05, 1.5, 5e6, None, 1e30, 1.0]
    got = {(r.id, r.place): r for r in check(spark, texts, values).collect()}
    assert (got[1, 0].low, got[1, 0].high, got[1, 0].matches) == (12450.0, 12550.0, 4)
    assert got[1, 2].matches == 2 and not got[6, 0].supported and got[6, 0].mention.startswith("1234")
    assert got[7, 0].supported


def test_random_numbers(spark):
    r = random.Random(7)
    values = [round(r.choice([1, 100, 1e4, 1e7]) * r.random(), r.randint(0, 4)) for _ in range(300)]
    number = lambda: f"{r.choice(values) * r.choice([1, 1, 0.001, 1e-6, 100]):,.{r.randint(0, 3)}f}{r.choice(['', 'K', ' million', '%', ' %', ' b'])}"
    check(spark, [(k, "; ".join(number() for _ in range(r.randint(0, 8)))) for k in range(80)], values)


def test_empty(spark):
    check(spark, [(1, "12 and 5%")], [None])
    check(spark, [(1, "no number")], [1.0])
