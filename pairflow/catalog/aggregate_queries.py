"""Aggregations (D1-D19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairflow.catalog.io_queries import SPLIT_OF
from pairflow.catalog.registry import query, round_columns
from pairflow.catalog.views import OBS, ROLES, obs, roles
from pairflow.functions import fixed
from pairflow.operators import aggregates as d
from pairflow.operators import histograms as h
from pairflow.operators.splits import assign_pair_splits


@query("d1_value_counts", """
SELECT event_type, n, row_number() OVER (ORDER BY n DESC, event_type) AS pos FROM (
  SELECT nullif(event_type, 'error') AS event_type, count(*) AS n FROM events GROUP BY 1) WHERE event_type IS NOT NULL""")
def _(t):
    counts = d.value_counts(t.events.select(F.nullif("event_type", F.lit("error")).alias("event_type")), "event_type")
    return counts.withColumn("pos", F.expr("row_number() over (order by n desc, event_type)"))


@query("d2_group_max_sorted", "SELECT o_custkey, max(o_totalprice) AS largest FROM orders GROUP BY 1")
def _(t):
    return d.group_max_sorted(t.orders, "o_custkey", "o_totalprice", "largest")


@query("d3_group_mean", f"""
WITH {OBS}
SELECT m1, m2, temperature_k, round(avg(x1), 6) + 0.0 AS x1, round(avg(ln_gamma_1), 6) + 0.0 AS ln_gamma_1,
       round(avg(ln_gamma_2), 6) + 0.0 AS ln_gamma_2 FROM obs GROUP BY 1, 2, 3""")
def _(t):
    return round_columns(d.group_mean(obs(t)), ["x1", "ln_gamma_1", "ln_gamma_2"])


@query("d4_limit_groups", f"""
WITH {OBS}, good AS (
  SELECT m1, m2, temperature_k FROM obs GROUP BY 1, 2, 3
  HAVING min(ln_gamma_1) >= -3 AND max(ln_gamma_1) < 1.56 AND min(ln_gamma_2) >= -2 AND max(ln_gamma_2) < 1.95)
SELECT row_id, m1, m2, temperature_k FROM obs JOIN good USING (m1, m2, temperature_k)""")
def _(t):
    bounds = {"ln_gamma_1": (-3.0, 1.56), "ln_gamma_2": (-2.0, 1.95)}
    return d.limit_groups(obs(t), ["m1", "m2", "temperature_k"], bounds).select("row_id", "m1", "m2", "temperature_k")


@query("d5_min_group_size", f"""
WITH {OBS}, n AS (SELECT *, count(*) OVER (PARTITION BY m1, m2, temperature_k) AS n FROM obs)
SELECT row_id, m1, m2, temperature_k FROM n WHERE n >= 4""")
def _(t):
    return d.min_group_size(obs(t)).select("row_id", "m1", "m2", "temperature_k")


@query("d5_group_sizes", f"""
WITH {OBS} SELECT m1, m2, temperature_k, count(*) AS n, count(*) < 4 AS skipped FROM obs GROUP BY 1, 2, 3""")
def _(t):
    return d.group_sizes(obs(t))


# Truth and a prediction with an error that depends on the row.
PREDICTED = """pred AS (
  SELECT *, ln_gamma_1 + 0.1 * x1 AS p1, 0.9 * ln_gamma_2 AS p2,
         CASE WHEN x1 < 0.5 THEN 'test_mix' ELSE 'valid_cont' END AS holdout_set,
         'DG' || CAST(m1 % 2 AS VARCHAR) AS model_name FROM obs)"""
SCORES = """
  sqrt(avg(pow(ln_gamma_1 - p1, 2))) AS rmse1, sqrt(avg(pow(ln_gamma_2 - p2, 2))) AS rmse2,
  avg(abs(ln_gamma_1 - p1)) AS mae1, avg(abs(ln_gamma_2 - p2)) AS mae2,
  1 - sum(pow(ln_gamma_1 - p1, 2)) / (var_pop(ln_gamma_1) * count(*)) AS r21,
  1 - sum(pow(ln_gamma_2 - p2, 2)) / (var_pop(ln_gamma_2) * count(*)) AS r22"""


def predicted(t):
    return obs(t).withColumns(
        {
            "ln_gamma_1_pred": F.col("ln_gamma_1") + F.lit(0.1) * F.col("x1"),
            "ln_gamma_2_pred": F.lit(0.9) * F.col("ln_gamma_2"),
            "holdout_set": F.when(F.col("x1") < 0.5, "test_mix").otherwise("valid_cont"),
            "model_name": F.concat(F.lit("DG"), (F.col("m1") % 2).cast("string")),
        }
    )


NAMES = [f"{g}_{m}" for m in ("rmse", "mae", "r2") for g in ("ln_gamma_1", "ln_gamma_2")]


def _score_sql(places, select="", tail="", fn="round"):
    names = zip(("rmse1", "rmse2", "mae1", "mae2", "r21", "r22"), NAMES)
    columns = ", ".join(f"{fn}({a}, {places})::DOUBLE + 0.0 AS {b}" for a, b in names)
    return f"WITH {OBS}, {PREDICTED}, s AS (SELECT {select} {SCORES} FROM pred {tail}) SELECT * EXCLUDE (rmse1, rmse2, mae1, mae2, r21, r22), {columns} FROM s"


@query("d6_regression_scores", _score_sql(9))
def _(t):
    return round_columns(d.regression_scores(predicted(t)), NAMES, 9)


@query("d7_scores_by_holdout", _score_sql(4, "holdout_set, model_name,", "GROUP BY 1, 2", "round_even"))
def _(t):
    return d.scores_by_holdout(predicted(t))


@query("d8_mae", f"WITH {OBS}, {PREDICTED} SELECT m1, round(avg(abs(ln_gamma_1 - p1)), 9) AS e1, round(avg(abs(ln_gamma_2 - p2)), 9) AS e2 FROM pred GROUP BY 1")
def _(t):
    pairs = {"e1": ("ln_gamma_1", "ln_gamma_1_pred"), "e2": ("ln_gamma_2", "ln_gamma_2_pred")}
    return round_columns(d.mae(predicted(t), pairs, ["m1"]), ["e1", "e2"], 9)


@query("d9_low_cardinality_profile", """
WITH v AS (
  SELECT DISTINCT 'l_returnflag' AS "column", l_returnflag AS value FROM lineitem UNION ALL
  SELECT DISTINCT 'l_linestatus', l_linestatus FROM lineitem UNION ALL
  SELECT DISTINCT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem UNION ALL
  SELECT DISTINCT 'l_tax', CAST(l_tax AS VARCHAR) FROM lineitem UNION ALL
  SELECT DISTINCT 'l_discount', CAST(l_discount AS VARCHAR) FROM lineitem UNION ALL
  SELECT DISTINCT 'l_quantity', CAST(l_quantity AS VARCHAR) FROM lineitem UNION ALL
  SELECT DISTINCT 'gap', CASE WHEN l_linenumber > 3 THEN l_returnflag END FROM lineitem)
SELECT "column", value FROM v WHERE "column" IN (SELECT "column" FROM v GROUP BY 1 HAVING count(*) < 10)""")
def _(t):
    columns = ["l_returnflag", "l_linestatus", "l_linenumber", "l_tax", "l_discount", "l_quantity"]
    return d.low_cardinality_profile(t.lineitem.select(*columns, F.when(F.col("l_linenumber") > 3, F.col("l_returnflag")).alias("gap")))


@query("d10_fraction_where", """
SELECT l_returnflag, round(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) / count(*), 9) AS fraction FROM lineitem GROUP BY 1""")
def _(t):
    return round_columns(d.fraction_where(t.lineitem, F.col("l_quantity") > 25, ["l_returnflag"]), ["fraction"], 9)


@query("d11_min_max", """
SELECT l_returnflag, min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice,
       min(l_tax) AS min_l_tax, max(l_tax) AS max_l_tax FROM lineitem GROUP BY 1""")
def _(t):
    return d.min_max(t.lineitem, ["l_extendedprice", "l_tax"], ["l_returnflag"])


@query("d12_dedup_subset", """
SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, nullif(l_returnflag, 'A') ORDER BY l_orderkey, l_linenumber, l_suppkey) AS k
  FROM (SELECT l_partkey, nullif(l_returnflag, 'A') AS l_returnflag, l_orderkey, l_linenumber, l_suppkey FROM lineitem)) WHERE k = 1""")
def _(t):
    order = ["l_orderkey", "l_linenumber", "l_suppkey"]
    rows = t.lineitem.select("l_partkey", F.nullif("l_returnflag", F.lit("A")).alias("l_returnflag"), *order)
    return d.dedup_subset(rows, ["l_partkey", "l_returnflag"], order)


@query("d12_dedup_all_columns", "SELECT DISTINCT l_partkey, l_returnflag, l_linestatus FROM lineitem")
def _(t):
    return d.dedup_subset(t.lineitem.select("l_partkey", "l_returnflag", "l_linestatus"))


# Equal-width bins with the edges lo + k * (hi - lo) / n; a value on an edge opens a bin.
HISTOGRAM = """
WITH v AS (SELECT {by} value AS v FROM events WHERE value IS NOT NULL),
e AS (SELECT {by} min(v) AS lo, max(v) AS hi FROM v {group}),
b AS (SELECT e.*, k.k::INTEGER AS bin, lo + k.k * ((hi - lo) / {n}.0::DOUBLE) AS bin_lo, lo + (k.k + 1) * ((hi - lo) / {n}.0::DOUBLE) AS bin_hi
      FROM e, range(0, {n}) k(k))
SELECT {pick} bin, bin_lo, bin_hi,
       (SELECT count(*) FROM v WHERE {same} v >= bin_lo AND (v < bin_hi OR bin = {n} - 1)) AS n
FROM b"""


@query("d13_histogram", HISTOGRAM.format(by="event_type,", group="GROUP BY 1", n=10, pick="b.event_type,", same="v.event_type = b.event_type AND"))
def _(t):
    return h.histogram(t.events, "value", 10, by=["event_type"])


@query("d13_histogram_whole", HISTOGRAM.format(by="", group="", n=20, pick="", same=""))
def _(t):
    return h.histogram(t.events, "value", 20)


@query("d14_histogram_edges", f"""
WITH v AS (SELECT l_returnflag, (l_extendedprice - 50000) / 1000 AS v FROM lineitem),
e AS (SELECT unnest({fixed.HISTOGRAM_EDGES[:-1]}) AS lo, unnest({fixed.HISTOGRAM_EDGES[1:]}) AS hi),
b AS (SELECT *, row_number() OVER (ORDER BY lo) - 1 AS bin FROM e),
f AS (SELECT DISTINCT l_returnflag FROM lineitem)
SELECT l_returnflag, bin, lo::DOUBLE AS bin_lo, hi::DOUBLE AS bin_hi,
  (SELECT count(*) FROM v WHERE v.l_returnflag = f.l_returnflag AND v >= lo AND (v < hi OR (hi = 60 AND v = 60))) AS n FROM f, b""")
def _(t):
    v = t.lineitem.select("l_returnflag", ((F.col("l_extendedprice") - 50000) / 1000).alias("v"))
    return h.histogram_edges(v, "v", by=["l_returnflag"])


@query("d15_histogram_2d", """
WITH e AS (SELECT min(l_quantity) AS xl, (max(l_quantity) - min(l_quantity)) / 8.0::DOUBLE AS xs,
                  min(l_discount) AS yl, (max(l_discount) - min(l_discount)) / 5.0::DOUBLE AS ys FROM lineitem),
k AS (SELECT len(list_filter(range(1, 8), lambda k: l_quantity >= xl + k * xs))::INTEGER AS bin_x,
             len(list_filter(range(1, 5), lambda k: l_discount >= yl + k * ys))::INTEGER AS bin_y FROM lineitem, e)
SELECT bin_x, bin_y, count(*) AS n FROM k GROUP BY 1, 2""")
def _(t):
    return h.histogram_2d(t.lineitem, "l_quantity", "l_discount", (8, 5))


@query("d16_kde", """
WITH s AS (SELECT event_type, stddev_samp(value) * pow(count(value), -0.2) AS h FROM events GROUP BY 1),
g AS (SELECT k::INTEGER AS point, -50 + k * (300.0::DOUBLE / 40) AS x FROM range(0, 41) r(k))
SELECT event_type, point, round(g.x, 6) + 0.0 AS x,
       round(sum(exp(-pow((g.x - value) / h, 2) / 2)) / (count(*) * h * sqrt(2 * pi())), 9) + 0.0 AS density
FROM events JOIN s USING (event_type), g GROUP BY event_type, point, g.x, h""")
def _(t):
    return round_columns(round_columns(h.kde(t.events, "value", ["event_type"], -50, 250, 41), ["x"]), ["density"], 9)


@query("d17_split_sizes", f"""{SPLIT_OF},
u AS (SELECT split, m1 AS m FROM s UNION SELECT split, m2 FROM s)
SELECT split, count(*) AS n_rows, (SELECT count(*) FROM u WHERE u.split = s.split) AS n_entities
FROM s WHERE split IS NOT NULL GROUP BY 1""")
def _(t):
    return d.split_sizes(assign_pair_splits(obs(t), roles(t), "id"), ["m1", "m2"])


@query("d18_all_in_range", """
SELECT min(l_quantity) >= 0 AND max(l_quantity) < 51 AND min(l_discount) >= 0 AND max(l_discount) < 51 AS all_in_range FROM lineitem""")
def _(t):
    return d.all_in_range(t.lineitem, ["l_quantity", "l_discount"], 0, 51)


@query("d19_distinct_values", "SELECT DISTINCT l_suppkey FROM lineitem")
def _(t):
    return d.distinct_values(t.lineitem, "l_suppkey")
