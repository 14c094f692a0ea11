"""Scalar functions (H1-H16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairflow.catalog.registry import query, rounded
from pairflow.catalog.views import OBS, obs
from pairflow.functions import scalars as fn
from pairflow.functions.models import nrtl_ln_gamma
from pairflow.functions.text import chunk_lines, extract_block, extract_names, split_ids, text_lines
from pairflow.operators.aggregates import column_residual_norm
from pairflow.operators.fits import eval_polynomial
from pairflow.plans.jobs import condition_grid
from pairflow.sources.blocks import format_blocks

L = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query("h1_abs_error", f"""
SELECT {LINE_KEYS}, round(l_discount - l_tax, 6) + 0.0 AS signed_error, round(abs(l_discount - l_tax), 6) AS abs_error FROM lineitem""")
def _(t):
    return t.lineitem.select(
        *L, rounded(fn.signed_error("l_discount", "l_tax")).alias("signed_error"),
        rounded(fn.abs_error("l_discount", "l_tax")).alias("abs_error"),
    )


@query("h2_ln_value", """
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) + 0.0 END AS ln_value FROM customer""")
def _(t):
    return t.customer.select("c_custkey", rounded(fn.ln_value("c_acctbal")).alias("ln_value"))


@query("h3_eval_polynomial", f"""
WITH {OBS}
SELECT row_id,
       round(0.5 + m1 * x1 - 2.0 * pow(x1, 2) + 1.5 * pow(x1, 3) - 0.25 * pow(x1, 4), 8) + 0.0 AS ln_gamma_1_pred,
       round(-0.5 + m2 * x1 + 0.75 * pow(x1, 2) - 1.25 * pow(x1, 3) + 0.125 * pow(x1, 4), 8) + 0.0 AS ln_gamma_2_pred FROM obs""")
def _(t):
    return _evaluated(t, "x")


@query("h3_eval_polynomial_compat", f"""
WITH {OBS}
SELECT row_id,
       round(0.5 + m1 * x1 - 2.0 * pow(x1, 2) + 1.5 * pow(x1, 3) - 0.25 * pow(x1, 4), 8) + 0.0 AS ln_gamma_1_pred,
       round(-0.5 + m2 * (1 - x1) + 0.75 * pow(1 - x1, 2) - 1.25 * pow(1 - x1, 3) + 0.125 * pow(1 - x1, 4), 8) + 0.0 AS ln_gamma_2_pred
FROM obs""")
def _(t):
    return _evaluated(t, "one_minus_x")


def _evaluated(t, basis):
    cs = {"c0_0": 0.5, "c2_0": -2.0, "c3_0": 1.5, "c4_0": -0.25, "c0_1": -0.5, "c2_1": 0.75, "c3_1": -1.25, "c4_1": 0.125}
    df = obs(t).withColumns({k: F.lit(v) for k, v in cs.items()} | {"c1_0": F.col("m1"), "c1_1": F.col("m2")})
    out = eval_polynomial(df, basis=basis)
    return out.select("row_id", *[rounded(c, 8).alias(c) for c in ("ln_gamma_1_pred", "ln_gamma_2_pred")])


@query("h4_nrtl_ln_gamma", f"""
WITH {OBS}, p AS (SELECT row_id, x1, 1 - x1 AS x2, 0.2 AS a12, 0.1 + m1 / 50.0 AS a21,
                  (m1 - 12) / 5.0 AS t12, (m2 - 12) / 5.0 AS t21 FROM obs),
g AS (SELECT *, exp(-a12 * t12) AS g12, exp(-a21 * t21) AS g21 FROM p)
SELECT row_id,
  round(pow(x2, 2) * (t21 * pow(g21 / (x1 + x2 * g21), 2) + t12 * g12 / pow(x2 + x1 * g12, 2)), 6) + 0.0 AS ln_1,
  round(pow(x1, 2) * (t12 * pow(g12 / (x2 + x1 * g12), 2) + t21 * g21 / pow(x1 + x2 * g21, 2)), 6) + 0.0 AS ln_2
FROM g""")
def _(t):
    tau = lambda m: (F.col(m) - 12) / F.lit(5.0)
    one, two = nrtl_ln_gamma(
        F.lit(0.2), tau("m1"), tau("m2"), "x1", F.lit(1.0) - F.col("x1"), a21=F.lit(0.1) + F.col("m1") / F.lit(50.0)
    )
    return obs(t).select("row_id", rounded(one).alias("ln_1"), rounded(two).alias("ln_2"))


@query("h5_nan_to_num", """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0.0 WHEN event_id % 10 = 1 THEN 1.7976931348623157e308
       WHEN event_id % 10 = 2 THEN -1.7976931348623157e308 ELSE value END::DOUBLE AS value FROM events""")
def _(t):
    k = F.col("event_id") % 10
    odd = (
        F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf"))).otherwise(F.col("value"))
    )
    return t.events.select("event_id", fn.nan_to_num(odd).alias("value"))


@query("h6_round4", f"SELECT {LINE_KEYS}, round_even(l_extendedprice / 7.0, 4)::DOUBLE AS price FROM lineitem")
def _(t):
    return t.lineitem.select(*L, fn.round4(F.col("l_extendedprice") / F.lit(7.0)).alias("price"))


@query("h7_format_score", """
SELECT o_orderkey, 'RMSE = ' || printf('%.3f', o_totalprice / 7.0) AS label,
       o_orderpriority || ' & ' || o_orderstatus || ' \\\\' AS latex FROM orders""")
def _(t):
    return t.orders.select(
        "o_orderkey", fn.format_score("RMSE", F.col("o_totalprice") / F.lit(7.0)).alias("label"),
        fn.latex_row("o_orderpriority", "o_orderstatus").alias("latex"),
    )


@query("h8_split_ids", f"""
WITH {OBS}, f AS (SELECT row_id, '/data/run__1/cat' || m1 || '__bat' || m2 || '_ct.tab' AS path FROM obs)
SELECT row_id, regexp_extract(path, '([^/]*)__([^/]*)_ct[.]tab$', 1) AS id_1,
       regexp_extract(path, '([^/]*)__([^/]*)_ct[.]tab$', 2) AS id_2 FROM f""")
def _(t):
    path = F.concat(F.lit("/data/run__1/cat"), F.col("m1"), F.lit("__bat"), F.col("m2"), F.lit("_ct.tab"))
    one, two = split_ids(path)
    return obs(t).select("row_id", one.alias("id_1"), two.alias("id_2"))


@query("h9_chunk_lines", r"""
WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS lines FROM documents)
SELECT doc_id, k::INTEGER AS chunk, array_to_string(lines[k * 8 + 1 : k * 8 + 8], '|') AS lines
FROM l, LATERAL (SELECT unnest(range(0, len(lines) // 8)) AS k)""")
def _(t):
    chunks = F.posexplode(chunk_lines(text_lines("text")))
    return t.documents.select("doc_id", chunks.alias("chunk", "part")).select(
        "doc_id", "chunk", F.array_join("part", "|").alias("lines")
    )


@query("h10_extract_block", f"""
WITH {OBS}
SELECT row_id, temperature_k, x1, round(1 - x1, 4) + 0.0 AS x2,
       round(ln_gamma_1, 6) + 0.0 AS ln_gamma_1, round(ln_gamma_2, 6) + 0.0 AS ln_gamma_2 FROM obs""")
def _(t):
    lines = format_blocks(obs(t)).select("row_id", text_lines("text").alias("lines"))
    parsed = extract_block(lines, "lines")
    return parsed.select(
        "row_id", "temperature_k", "x1", rounded("x2", 4).alias("x2"), rounded("ln_gamma_1").alias("ln_gamma_1"),
        rounded("ln_gamma_2").alias("ln_gamma_2"),
    )


@query("h11_extract_names", r"""
WITH f AS (SELECT p_partkey, replace(p_name, ' ', '-') AS n1, p_brand AS n2 FROM part),
h AS (SELECT p_partkey, 'head' || chr(10) || '   1 ' || n1 || ' 0.1' || chr(10) ||
             CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '   2 ' || p_partkey || '(' || 'x),y 0.2' END || chr(10) AS head FROM f),
n AS (SELECT p_partkey, regexp_extract_all(head, '\s\s\s\d\s([\w(),\-]+)', 1) AS names FROM h)
SELECT p_partkey, CASE WHEN len(names) = 2 THEN names[1] END AS names_1, CASE WHEN len(names) = 2 THEN names[2] END AS names_2 FROM n""")
def _(t):
    second = F.concat(F.lit("   2 "), F.col("p_partkey").cast("string"), F.lit("(x),y 0.2"))
    lines = F.array(
        F.lit("head"), F.concat(F.lit("   1 "), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(" 0.1")),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(second),
    )
    one, two = extract_names(lines)
    return t.part.select("p_partkey", one.alias("names_1"), two.alias("names_2"))


@query("h12_temperature_window", """
SELECT o_orderkey, least(c_acctbal, o_totalprice / 50) AS t_min, greatest(c_acctbal, o_totalprice / 50) AS t_max
FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    lo, hi = fn.temperature_bounds("c_acctbal", F.col("o_totalprice") / 50)
    return joined.select("o_orderkey", lo.alias("t_min"), hi.alias("t_max"))


@query("h13_condition_grid", """
WITH w AS (SELECT s_suppkey, s_acctbal AS lo, s_acctbal + 40 AS hi FROM supplier)
SELECT s_suppkey, round(i / 10.0, 6) AS x1, round(lo + j * (hi - lo) / 4.0, 4) + 0.0 AS temperature_k
FROM w, range(0, 11) a(i), range(0, 5) b(j)""")
def _(t):
    w = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("t_min"), (F.col("s_acctbal") + 40).alias("t_max"))
    return condition_grid(w).select("s_suppkey", rounded("x1").alias("x1"), rounded("temperature_k", 4).alias("temperature_k"))


@query("h14_flatten", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_orderkey || ',' || l_partkey || ',' || l_suppkey || ',' || l_linenumber AS flat FROM lineitem""")
def _(t):
    nested = F.array(F.array("l_orderkey", "l_partkey"), F.array(F.col("l_suppkey"), F.col("l_linenumber").cast("long")))
    return t.lineitem.select(*L, F.array_join(fn.flatten_lists(nested).cast("array<string>"), ",").alias("flat"))


@query("h15_column_residual_norm", f"""
WITH {OBS} SELECT m1, m2, round(max(greatest(ln_gamma_1, ln_gamma_2)), 6) + 0.0 AS norm FROM obs GROUP BY m1, m2""")
def _(t):
    return column_residual_norm(obs(t), ["ln_gamma_1", "ln_gamma_2"], ["m1", "m2"]).select("m1", "m2", rounded("norm").alias("norm"))


@query("h16_mixture_key", f"WITH {OBS} SELECT row_id, m1 || '__' || m2 AS mixture FROM obs")
def _(t):
    return obs(t).select("row_id", fn.mixture_key("m1", "m2").alias("mixture"))
