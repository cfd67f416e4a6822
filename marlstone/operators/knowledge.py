"""Hypotheses, life cycles, reports and a scored knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.safe import sdiv

#: Allowed changes of status. Fixed values.
HYPOTHESIS = {"draft": ("active", "rejected"), "active": ("verified", "invalidated", "obsolete"), "verified": ("obsolete",), "invalidated": ("obsolete",), "rejected": ("obsolete",), "obsolete": ()}
FAILURE = {"new": ("reviewed",), "reviewed": ("actioned", "archived"), "actioned": ("archived",), "archived": ()}


def factor_hypotheses(ics: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(factor_name, ticker, ic, direction, status) of the coefficients beyond the threshold; nulls give none."""
    side = F.when(F.col("ic") > threshold, "positive").when(F.col("ic") < -threshold, "negative")
    return ics.withColumns({"direction": side, "status": F.lit("draft")}).where("direction is not null").select("factor_name", "ticker", "ic", "direction", "status")


def run_hypotheses(runs: DataFrame, regime: Column, threshold: float = 0.15) -> DataFrame:
    """(run_id, strategy, annual_return, market_regime, status) of the runs that return more than the threshold."""
    return runs.where(F.col("annual_return") > threshold).select("run_id", "strategy", "annual_return", regime.alias("market_regime"), F.lit("draft").alias("status"))


def transition(records: DataFrame, changes: DataFrame, allowed: dict[str, tuple] = HYPOTHESIS) -> DataFrame:
    """records (id, status) with their status after changes (id, new_status), and ``error`` where one is not allowed.

    Changes of unknown ids come out as rows with the error unknown; a record has one change at most.
    """
    pairs = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    j = records.join(changes, "id", "full")
    fine = F.coalesce(F.array_contains(F.try_element_at(pairs, F.col("status")), F.col("new_status")), F.lit(False))
    error = F.when(F.col("status").isNull(), "unknown").when(F.col("new_status").isNotNull() & ~fine, "not_allowed")
    return j.select("id", F.when(fine, F.col("new_status")).otherwise(F.col("status")).alias("status"), error.alias("error"))


def score_entries(entries: DataFrame, query: str, regime: str | None = None, timeframe: str | None = None, kind: str | None = None, k: int = 5) -> DataFrame:
    """(id, score) of the best entries (id, title, keywords, tags, content, type, market_regime, timeframe).

    Title words weigh 0.35, keywords 0.25, tags or, by half, the first 200 characters 0.15, the regime 0.15, the time
    frame 0.10; an entry without any match scores 0.02. Equal scores by id.
    """
    own = entries.where(F.col("type") == kind) if kind else entries
    words = F.array_distinct(F.filter(F.split(F.lit(query.lower()), r"[^\w]+"), lambda x: x != ""))
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda x: x != ""))
    n = F.size(words)
    hits = lambda t: F.size(F.array_intersect(words, t))
    share = lambda h: F.least(F.coalesce(sdiv(h, n), F.lit(0.0)), F.lit(1.0))
    joined = lambda c: tokens(F.array_join(F.coalesce(c, F.array().cast("array<string>")), " "))
    tag = F.greatest(hits(joined("tags")).cast("double"), hits(tokens(F.substring("content", 1, 200))) * 0.5)
    parts = 0.35 * share(hits(tokens("title"))) + 0.25 * share(hits(joined("keywords"))) + 0.15 * share(tag)
    if regime:
        wanted = regime.lower().replace(" ", "_")
        parts = parts + F.when(F.exists(F.coalesce("market_regime", F.array().cast("array<string>")), lambda m: F.lower(m).contains(wanted) | F.lit(wanted).contains(F.lower(m))), 0.15).otherwise(0.0)
    if timeframe:
        parts = parts + F.when(F.exists(F.coalesce("timeframe", F.array().cast("array<string>")), lambda t: F.lower(t).contains(timeframe.lower()) | (t == "all")), 0.10).otherwise(0.0)
    return own.select("id", "title", F.when(parts > 0, parts).otherwise(0.02).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def prompt(best: DataFrame) -> DataFrame:
    """One row: the best entries' titles and scores as text; there are as many as were asked for."""
    line = F.concat(F.lit("- "), F.col("title"), F.lit(" ("), F.format_number("score", 3), F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", line.alias("line"))))
    return best.agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("prompt"))


def last_days(calendar: DataFrame, n: int) -> DataFrame:
    """The last n trading days."""
    return calendar.select("date").distinct().orderBy(F.desc("date")).limit(n)


def roll_up(days: DataFrame, unit: str, below: str) -> DataFrame:
    """(period, n, parts): of each ``unit`` (week, month, quarter) the ``below`` (day, week, month) that has reports."""
    inner = F.to_date(F.date_trunc(below, "date")) if below != "day" else F.col("date")
    # a week belongs to the period in which it begins
    parts = days.select(inner.alias("part")).distinct()
    return parts.groupBy(F.to_date(F.date_trunc(unit, "part")).alias("period")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.date_format("part", "yyyy-MM-dd"))), ",").alias("parts"))


def grade(score: Column) -> Column:
    return F.when(score >= 7, "A").when(score >= 5, "B").when(score >= 3, "C").otherwise("D")


def factor_score(icir: Column, long_short: Column, monotonic: Column) -> Column:
    """At most 10: three for the ICIR, three for the return between the outer groups, two for their order."""
    part = lambda c, by: F.coalesce(F.least(F.abs(c) * by, F.lit(3.0)), F.lit(0.0))
    return F.least(part(icir, 0.5) + part(long_short, 20.0) + F.when(monotonic, 2.0).otherwise(0.0), F.lit(10.0))


def quarter_of(text: Column) -> Column:
    """A quarter that a text names, as 2024Q3: "2024Q3", "2024 Q3", "Q3 2024" or "third quarter of 2024"; else null."""
    low = F.lower(text)
    year_first = F.regexp_extract(low, r"(20\d\d)\s*[-/]?\s*q([1-4])", 0)
    quarter_first = F.regexp_extract(low, r"q([1-4])\s*[-/]?\s*(20\d\d)", 0)
    spelled = F.regexp_extract(low, r"(first|second|third|fourth) quarter of (20\d\d)", 0)
    word = F.create_map(*[F.lit(x) for kv in (("first", "1"), ("second", "2"), ("third", "3"), ("fourth", "4")) for x in kv])
    return (
        F.when(year_first != "", F.concat(F.substring(year_first, 1, 4), F.lit("Q"), F.substring(year_first, -1, 1)))
        .when(quarter_first != "", F.concat(F.substring(quarter_first, -4, 4), F.lit("Q"), F.substring(quarter_first, 2, 1)))
        .when(spelled != "", F.concat(F.substring(spelled, -4, 4), F.lit("Q"), F.try_element_at(word, F.substring_index(spelled, " ", 1))))
    )


def candles(bars: DataFrame) -> DataFrame:
    """bars with three patterns: a fall after a limit rise, a long upper shadow, and the rises among the last five."""
    w = Window.partitionBy("ticker").orderBy("date")
    c1, c2, c3 = F.col("close"), F.lag("close", 1).over(w), F.lag("close", 2).over(w)
    fall = (sdiv(c2, c3) > 1.095) & (c1 < F.col("open")) & (c1 < c2 * 0.98)
    span = F.col("high") - F.col("low")
    shadow = (F.col("high") - F.greatest("close", "open") > span * 0.6) & (span > 0)
    own = bars.withColumns({"after_limit": F.coalesce(fall, F.lit(False)), "long_shadow": F.coalesce(shadow, F.lit(False)), "_up": F.coalesce((c1 > c2).cast("int"), F.lit(0))})
    # of five bars there are four changes
    return own.withColumn("rises", F.sum("_up").over(w.rowsBetween(-3, 0))).drop("_up")
