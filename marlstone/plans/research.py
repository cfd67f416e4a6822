"""Evaluation queries over the factors of the brands and the cross-section of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import evaluate as ev
from marlstone.operators import factors as fac
from marlstone.registry import query

from .factors import FORMULAS, STEPS, panel
from .views import XSEC, xsec

R = lambda c, n=6: F.round(c, n)
W = "PARTITION BY ticker ORDER BY date"
PAIRS = f"""{STEPS}, fr AS (SELECT ticker, date, close, {FORMULAS['momentum_20d']} AS factor, lead(close, 5) OVER ({W}) / NULLIF(close, 0) - 1 AS fwd FROM s3)"""


def pairs(spark, sf_dir, name="momentum_20d"):
    own = panel(spark, sf_dir, [name]).select("ticker", "date", "close", F.col(name).alias("factor"))
    return own.withColumn("fwd", ev.forward_return(5))


RANKED = f"""{PAIRS}, v AS (SELECT *, rank() OVER (PARTITION BY ticker ORDER BY factor) + (count(*) OVER (PARTITION BY ticker, factor) - 1) / 2.0::DOUBLE AS rx,
 rank() OVER (PARTITION BY ticker ORDER BY fwd) + (count(*) OVER (PARTITION BY ticker, fwd) - 1) / 2.0::DOUBLE AS ry FROM fr WHERE factor IS NOT NULL AND fwd IS NOT NULL)"""


@query("ic_rolling", f"WITH {RANKED}, c AS (SELECT ticker, CASE WHEN count(*) OVER w = 60 THEN covar_samp(rx, ry) OVER w / NULLIF(stddev_samp(rx) OVER w * stddev_samp(ry) OVER w, 0) END AS ic FROM v WINDOW w AS ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) SELECT ticker, round(avg(ic), 6) AS ic, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / (stddev_samp(ic) + 1e-8), 6) AS icir, round(avg(CASE WHEN ic > 0 THEN 1 WHEN ic <= 0 THEN 0 END), 6) AS ic_positive_ratio, count(ic) AS n_periods FROM c GROUP BY ticker")
def ic_rolling(spark, sf_dir):
    return ev.rolling_ic(pairs(spark, sf_dir)).select("ticker", *[R(c).alias(c) for c in ("ic", "ic_std", "icir", "ic_positive_ratio")], "n_periods")


@query("ic_panel", f"WITH {RANKED} SELECT ticker, count(*) AS n, round(covar_samp(rx, ry) / NULLIF(stddev_samp(rx) * stddev_samp(ry), 0), 6) AS ic FROM v GROUP BY ticker")
def ic_panel(spark, sf_dir):
    v = pairs(spark, sf_dir).where("factor is not null and fwd is not null").withColumns({"rx": ev.avg_rank("factor", "ticker"), "ry": ev.avg_rank("fwd", "ticker")})
    return v.groupBy("ticker").agg(F.count("*").alias("n"), R(ev.safe_corr("rx", "ry")).alias("ic"))


BUCKETS = f"""{PAIRS}, v AS (SELECT * FROM fr WHERE factor IS NOT NULL AND fwd IS NOT NULL), e AS (SELECT ticker, quantile_cont(factor, [0.2, 0.4, 0.6, 0.8]) AS q FROM v GROUP BY ticker),
b AS (SELECT v.ticker, len(list_filter(list_distinct(q), lambda x: x < factor)) AS bucket, fwd FROM v JOIN e ON e.ticker = v.ticker),
g AS (SELECT ticker, bucket, avg(fwd) AS m, stddev_samp(fwd) AS s, count(*) AS n FROM b GROUP BY ALL),
st AS (SELECT *, m - lag(m) OVER (PARTITION BY ticker ORDER BY bucket) AS step FROM g)"""


@query("quantile_groups", f"WITH {BUCKETS} SELECT ticker, CAST(bucket AS INTEGER) AS bucket, round(m, 6) AS mean_return, round(s, 6) AS std_return, n, round(first_value(m) OVER (PARTITION BY ticker ORDER BY bucket DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - first_value(m) OVER (PARTITION BY ticker ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS long_short, coalesce(min(step) OVER (PARTITION BY ticker) > 0 OR max(step) OVER (PARTITION BY ticker) < 0, true) AS monotonic FROM st")
def quantile_groups(spark, sf_dir):
    g = ev.quantile_groups(pairs(spark, sf_dir))
    return g.select("ticker", "bucket", R("mean_return").alias("mean_return"), R("std_return").alias("std_return"), "n", R("long_short").alias("long_short"), "monotonic")


@query("factor_turnover", f"WITH {PAIRS}, v AS (SELECT ticker, date, (rank() OVER (PARTITION BY ticker ORDER BY factor) + (count(*) OVER (PARTITION BY ticker, factor) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY ticker) AS r FROM fr WHERE factor IS NOT NULL), c AS (SELECT ticker, abs(r - lag(r, 5) OVER ({W})) AS c FROM v) SELECT ticker, round(avg(c), 6) AS avg_turnover, round(1 - avg(c), 6) AS stability FROM c GROUP BY ticker")
def factor_turnover(spark, sf_dir):
    return ev.turnover(pairs(spark, sf_dir)).select("ticker", R("avg_turnover").alias("avg_turnover"), R("stability").alias("stability"))


_LAGS = f"WITH {PAIRS}, l AS (SELECT *, " + ", ".join(f"lead(close, {k}) OVER ({W}) / NULLIF(close, 0) - 1 AS f{k}" for k in range(1, 21)) + " FROM fr), c AS (SELECT ticker, " + ", ".join(f"covar_samp(factor, f{k}) / NULLIF(stddev_samp(factor) FILTER (f{k} IS NOT NULL) * stddev_samp(f{k}) FILTER (factor IS NOT NULL), 0) AS ic_{k}" for k in range(1, 21)) + " FROM l GROUP BY ticker) SELECT ticker, " + ", ".join(f"round(ic_{k}, 6) AS ic_{k}" for k in (1, 5, 10, 20)) + ", CAST(coalesce(" + ", ".join(f"CASE WHEN abs(ic_{k}) < abs(ic_1) / 2 THEN {k} END" for k in range(2, 21)) + ", 20) AS INTEGER) AS half_life FROM c"


@query("ic_decay_curve", _LAGS)
def ic_decay_curve(spark, sf_dir):
    d = ev.decay_curve(pairs(spark, sf_dir))
    return d.select("ticker", *[R(f"ic_{k}").alias(f"ic_{k}") for k in (1, 5, 10, 20)], "half_life")


@query("factor_grade", f"WITH {RANKED}, i AS (SELECT ticker, covar_samp(rx, ry) / NULLIF(stddev_samp(rx) * stddev_samp(ry), 0) AS ic FROM v GROUP BY ticker) SELECT ticker, CASE WHEN abs(ic) > 0.05 THEN 'A' WHEN abs(ic) > 0.03 THEN 'B' WHEN abs(ic) > 0.01 THEN 'C' ELSE 'D' END AS grade FROM i")
def factor_grade(spark, sf_dir):
    v = pairs(spark, sf_dir).where("factor is not null and fwd is not null").withColumns({"rx": ev.avg_rank("factor", "ticker"), "ry": ev.avg_rank("fwd", "ticker")})
    ic = F.abs("ic")
    return v.groupBy("ticker").agg(ev.safe_corr("rx", "ry").alias("ic")).select("ticker", F.when(ic > 0.05, "A").when(ic > 0.03, "B").when(ic > 0.01, "C").otherwise("D").alias("grade"))


NAMES = fac.list_factors()
_PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i:]]
WIDE = f"{STEPS}, wide AS (SELECT ticker, date, " + ", ".join(f"{FORMULAS[n]} AS {n}" for n in NAMES) + " FROM s3)"
MATRIX = f"{WIDE}, one AS (SELECT " + ", ".join(f"corr({a}, {b}) AS {a}__{b}" for a, b in _PAIRS) + """ FROM wide),
matrix AS (SELECT split_part(pair, '__', 1) AS factor_a, split_part(pair, '__', 2) AS factor_b, corr FROM (UNPIVOT one ON COLUMNS(*) INTO NAME pair VALUE corr))"""


@query("corr_matrix", f"WITH {MATRIX} SELECT factor_a, factor_b, round(corr, 6) AS corr FROM matrix")
def corr_matrix(spark, sf_dir):
    return ev.correlation_matrix(panel(spark, sf_dir), NAMES).withColumn("corr", R("corr"))


MATERIAL = f"WITH RECURSIVE {MATRIX}"


@query("high_corr_pairs", MATERIAL + " SELECT factor_a, factor_b, round(corr, 4) AS corr FROM matrix WHERE factor_a <> factor_b AND abs(corr) >= 0.7 ORDER BY abs(corr) DESC, 1, 2")
def high_corr_pairs(spark, sf_dir):
    m = ev.correlation_matrix(panel(spark, sf_dir), NAMES).where("factor_a != factor_b and abs(corr) >= 0.7")
    return m.orderBy(F.desc(F.abs("corr")), "factor_a", "factor_b").withColumn("corr", R("corr", 4))


@query("collinear_groups", MATERIAL + ", e AS (SELECT factor_a AS a, factor_b AS b FROM matrix WHERE factor_a <> factor_b AND abs(corr) >= 0.7 UNION SELECT factor_b, factor_a FROM matrix WHERE factor_a <> factor_b AND abs(corr) >= 0.7), reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b) SELECT a AS factor, least(a, min(b)) AS grp FROM reach GROUP BY a")
def collinear_groups(spark, sf_dir):
    return ev.collinear_groups(ev.correlation_matrix(panel(spark, sf_dir), NAMES), NAMES)


@query("neutralize_demean", f"WITH {XSEC} SELECT entity, round(f_revenue - avg(f_revenue) OVER (PARTITION BY industry), 4) AS f_revenue, round(f_discount - avg(f_discount) OVER (PARTITION BY industry), 8) AS f_discount FROM xsec")
def neutralize_demean(spark, sf_dir):
    d = ev.demean(xsec(spark, sf_dir), ["f_revenue", "f_discount"], "industry")
    return d.select("entity", R("f_revenue", 4).alias("f_revenue"), R("f_discount", 8).alias("f_discount"))


@query("neutralize_ols", f"WITH {XSEC}, z AS (SELECT *, (ln(cap) - avg(ln(cap)) OVER ()) / (stddev_pop(ln(cap)) OVER () + 1e-8) AS z FROM xsec), d AS (SELECT entity, f_discount - avg(f_discount) OVER (PARTITION BY industry) AS y, z - avg(z) OVER (PARTITION BY industry) AS x FROM z), b AS (SELECT sum(x * y) / sum(x * x) AS beta FROM d) SELECT entity, round(y - beta * x, 8) AS f_discount FROM d, b")
def neutralize_ols(spark, sf_dir):
    return ev.neutralise(xsec(spark, sf_dir), ["f_discount"], cap="cap").select("entity", R("f_discount", 8).alias("f_discount"))
