"""Scalar functions, models and text extraction on hand-made values."""

import math

import pytest
from pyspark.sql import functions as F

from pairflow.functions import scalars as fn
from pairflow.functions.models import nrtl_ln_gamma, polynomial
from pairflow.functions.text import base_name, chunk_lines, split_ids, text_lines
from pairflow.operators.vectors import bit_positions, char_ngrams, word_ngrams
from pairflow.sources.blocks import parse_blocks

NAN, INF = float("nan"), float("inf")


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_registry_ids(spark):
    ids = ["64-17-5", "7732-18-5", "50-00-0", "1234567-89-0", "ethanol", "see 64-17-5.", None, "064-17-5"]
    assert column(spark, ids, "string", fn.is_registry_id("v")) == [True, True, True, False, False, True, False, False]


def test_in_range_is_half_open_and_missing_fails(spark):
    values = [-2.0, 1.0, 1.5, None, NAN, -INF, 1.4999]
    assert column(spark, values, "double", fn.in_range("v", -2, 1.5)) == [True, True, False, False, False, False, True]


def test_nan_to_num(spark):
    got = column(spark, [NAN, INF, -INF, 2.0, None], "double", fn.nan_to_num("v"))
    assert got == [0.0, fn.MAX_DOUBLE, -fn.MAX_DOUBLE, 2.0, None]


def test_round4_is_half_even(spark):
    assert column(spark, [0.00005, 0.00015, 0.00025], "double", fn.round4("v")) == [0.0, 0.0002, 0.0002]


def test_ln_and_format(spark):
    assert column(spark, [1.0, 0.0, -1.0, None], "double", fn.ln_value("v")) == [0.0, None, None, None]
    assert column(spark, [0.12345], "double", fn.format_score("MAE", "v")) == ["MAE = 0.123"]
    assert column(spark, ["a"], "string", fn.latex_row("v", F.lit(2))) == ["a & 2 \\\\"]


def test_temperature_bounds_need_both(spark):
    df = spark.createDataFrame([(300.0, 350.0), (None, 350.0), (350.0, 300.0)], "a double, b double")
    got = df.select(*fn.temperature_bounds("a", "b")).collect()
    assert [tuple(r) for r in got] == [(300.0, 350.0), (None, None), (300.0, 350.0)]


def test_polynomial_zero_to_the_zero(spark):
    assert column(spark, [0.0, 2.0], "double", polynomial("v", [F.lit(float(c)) for c in (1, 2, 3)])) == [1.0, 17.0]


def test_nrtl_against_numbers(spark):
    def expected(a12, t12, t21, x1, a21):
        x2, g12, g21 = 1 - x1, math.exp(-a12 * t12), math.exp(-a21 * t21)
        one = x2**2 * (t21 * (g21 / (x1 + x2 * g21)) ** 2 + t12 * g12 / (x2 + x1 * g12) ** 2)
        two = x1**2 * (t12 * (g12 / (x2 + x1 * g12)) ** 2 + t21 * g21 / (x1 + x2 * g21) ** 2)
        return one, two

    for x1 in (0.0, 0.3, 1.0):
        pair = nrtl_ln_gamma(F.lit(0.3), F.lit(1.0), F.lit(0.5), F.col("v"), 1 - F.col("v"), a21=F.lit(0.2))
        got = [column(spark, [x1], "double", p)[0] for p in pair]
        assert got == pytest.approx(expected(0.3, 1.0, 0.5, x1, 0.2))


@pytest.mark.parametrize("tau", [366.0, -366.0])
@pytest.mark.parametrize("x1", [0.0, 0.5, 1.0])
def test_nrtl_extremes_are_finite(spark, tau, x1):
    for p in nrtl_ln_gamma(F.lit(1.0), F.lit(tau), F.lit(tau), F.col("v"), 1 - F.col("v")):
        value = column(spark, [x1], "double", p)[0]
        assert value is not None and math.isfinite(value)


BLOCK = [
    "Property  job 1", "Settings", "T= 298.15 K ; x(1)= 0.2500 ; x(2)= 0.7500 ;", "Units", "Method", "Nr Compound",
    "   1 ethanol  -0.125000", "   2 water  1.500000",
]
NO_X1 = [*BLOCK[:2], "T= 310.00 K ; x(2)= 1.0000 ;", *BLOCK[3:6], "   1 ethanol  0.250000", "   2 water  0.000000"]


def parsed(spark, text, path="/run__2/64-17-5__abcat_ct.tab", **options):
    files = spark.createDataFrame([(path, text)], "path string, text string")
    return parse_blocks(files, **options).orderBy("block").collect()


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_blocks_with_tail_and_missing_composition(spark, newline):
    rows = parsed(spark, newline.join(BLOCK + NO_X1 + ["tail"] * 3) + newline)
    assert len(rows) == 2
    assert (rows[0]["id_1"], rows[0]["id_2"]) == ("64-17-5", "abcat")
    assert (rows[0]["names_1"], rows[0]["names_2"]) == ("ethanol", "water")
    assert (rows[0]["temperature_k"], rows[0]["x1"], rows[0]["x2"]) == (298.15, 0.25, 0.75)
    assert (rows[0]["ln_gamma_1"], rows[0]["ln_gamma_2"]) == (-0.125, 1.5)
    assert (rows[1]["temperature_k"], rows[1]["x1"], rows[1]["x2"]) == (310.0, 0.0, 1.0)


def test_missing_temperature(spark):
    broken = [*BLOCK[:2], "x(1)= 0.5 ;", *BLOCK[3:]]
    with pytest.raises(Exception, match="No temperature found"):
        parsed(spark, "\n".join(broken))
    assert parsed(spark, "\n".join(broken), strict=False)[0]["temperature_k"] is None


def test_names_need_exactly_two(spark):
    one_name = [*BLOCK[:7], "2 water 1.500000"]
    assert parsed(spark, "\n".join(one_name))[0]["names_1"] is None


def test_short_text_has_no_block(spark):
    assert parsed(spark, "a\nb\nc") == []
    assert column(spark, ["a\nb\n"], "string", F.size(text_lines("v"))) == [2]
    assert column(spark, ["\n".join("abcdefgh" * 2) + "\nx"], "string", F.size(chunk_lines(text_lines("v")))) == [2]


def test_ngrams(spark):
    assert column(spark, ["abcab", "ab", "", None], "string", char_ngrams("v", 2)) == [["ab", "bc", "ca"], ["ab"], [], []]
    assert column(spark, [" The cat\nsat the cat"], "string", word_ngrams("v", 2)) == [["the cat", "cat sat", "sat the"]]
    assert column(spark, ["one"], "string", word_ngrams("v", 2)) == [["one"]]
    bits = column(spark, ["abcabc"], "string", bit_positions(char_ngrams("v", 3), 64))[0]
    assert bits == sorted(set(bits)) and all(0 <= b < 64 for b in bits)
    assert column(spark, [None], "string", bit_positions(char_ngrams("v", 3), 64)) == [[]]


def test_base_name_and_ids(spark):
    assert column(spark, ["/a__b/c__d_ct.tab"], "string", base_name("v")) == ["c__d_ct.tab"]
    assert column(spark, ["c__batcab_ct.tab"], "string", split_ids("v")[1]) == ["batcab"]


def test_category_and_hash(spark):
    rules = [("acid", "COOH"), ("alcohol", "OH")]
    assert column(spark, ["C-COOH", "C-OH", "C", None], "string", fn.first_category("v", rules)) == ["acid", "alcohol", "", ""]
    fractions = column(spark, list(range(200)), "int", fn.hash_fraction("v", 3))
    assert all(0 <= f < 1 for f in fractions) and 0.4 < sum(fractions) / 200 < 0.6
