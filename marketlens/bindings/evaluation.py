"""Returns of orders judged per strategy."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.bindings.registry import query
from marketlens.bindings.views import six, table
from marketlens.functions.numbers import six as r6
from marketlens.operators import evaluate as ev
from marketlens.operators.ordered import max_drawdown

#: Draws of the intervals of means, and of ratios.
DRAWS, RATIO_DRAWS = 4_000, 10_000
RET = """ret AS (SELECT o_orderpriority AS strategy, o_orderkey AS event, 'S' || CAST(o_custkey % 25 AS VARCHAR) AS station,
 CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
 CASE WHEN o_orderstatus = 'F' THEN l_quantity * (0.9 - l_discount * 4) ELSE -l_quantity * l_tax * 5 END AS pnl, l_quantity AS capital
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
evt AS (SELECT strategy, event, station, min(date) AS date, sum(pnl) AS pnl, sum(capital) AS capital FROM ret GROUP BY ALL),
perd AS (SELECT strategy, date, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, sum(pnl) AS pnl, sum(capital) AS capital
 FROM evt GROUP BY ALL)"""


def returns(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    won = F.col("o_orderstatus") == "F"
    return joined.select(
        F.col("o_orderpriority").alias("strategy"), F.col("o_orderkey").alias("event"),
        F.concat(F.lit("S"), (F.col("o_custkey") % 25).cast("string")).alias("station"),
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("date"),
        F.when(won, F.col("l_quantity") * (0.9 - F.col("l_discount") * 4))
        .otherwise(-F.col("l_quantity") * F.col("l_tax") * 5).alias("pnl"),
        F.col("l_quantity").alias("capital"),
    )


def event_returns(spark, d):
    return ev.event_rollup(returns(spark, d), ["strategy", "event", "station"])


def per_date(spark, d):
    return ev.date_rollup(event_returns(spark, d), ["strategy"])


def tidy(df, *columns):
    return df.withColumns({c: r6(F.col(c)) for c in columns})


@query("event_rollup", "D7", f"""WITH {RET} SELECT strategy, event, station, date, {six('pnl')} AS pnl,
 {six('capital')} AS capital FROM evt""")
def event_rollup(spark, d):
    return tidy(event_returns(spark, d), "pnl", "capital")


@query("date_rollup", "D8", f"""WITH {RET} SELECT strategy, date, trades, wins, {six('pnl')} AS pnl,
 {six('capital')} AS capital FROM perd""")
def date_rollup(spark, d):
    return tidy(per_date(spark, d), "pnl", "capital")


@query("strategy_summary", "D6", f"""WITH {RET} SELECT strategy, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins,
 {six('count(*) FILTER (pnl > 0) / count(*)')} AS win_rate, {six('sum(pnl)')} AS pnl, {six('avg(pnl / capital)')} AS mean_roi
FROM evt GROUP BY strategy""")
def strategy_summary(spark, d):
    return tidy(ev.strategy_summary(event_returns(spark, d), ["strategy"]), "win_rate", "pnl", "mean_roi")


BLOCKS = """blk AS (SELECT *, CAST(floor((least(7, n) * (p + 1) - 1) / n) AS BIGINT) AS block FROM (SELECT *,
 count(*) OVER (PARTITION BY strategy) AS n, row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS p FROM perd))"""


@query("blocks", "D9", f"""WITH {RET}, {BLOCKS} SELECT strategy, block, min(date) AS first_date, max(date) AS last_date,
 count(*) AS dates, {six('sum(pnl)')} AS pnl, {six('sum(capital)')} AS capital, {six('sum(pnl) / sum(capital)')} AS roi
FROM blk GROUP BY strategy, block""")
def blocks(spark, d):
    return tidy(ev.block_rollup(per_date(spark, d), ["strategy"], 7), "pnl", "capital", "roi")


@query("leave_one_out", "D10", f"""WITH {RET}, l AS (SELECT strategy, date, sum(pnl) OVER w - pnl AS a, sum(capital) OVER w - capital AS b
 FROM perd WINDOW w AS (PARTITION BY strategy))
SELECT strategy, date, {six('a')} AS pnl_without, {six('b')} AS capital_without, {six('a / b')} AS roi_without FROM l""")
def leave_one_out(spark, d):
    out = ev.leave_one_date_out(per_date(spark, d), ["strategy"])
    return tidy(out, "pnl_without", "capital_without", "roi_without")


@query("concentration", "D11", f"""WITH {RET}, r AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY pnl DESC, date) AS r FROM perd)
SELECT strategy, {six('sum(pnl) FILTER (r <= 1 AND pnl > 0) / sum(pnl) FILTER (pnl > 0)')} AS top1_share,
 {six('sum(pnl) FILTER (r <= 3 AND pnl > 0) / sum(pnl) FILTER (pnl > 0)')} AS top3_share,
 arg_max(date, pnl) AS best_date, arg_min(date, pnl) AS worst_date FROM r GROUP BY strategy""")
def concentration(spark, d):
    return tidy(ev.concentration(per_date(spark, d), ["strategy"]), "top1_share", "top3_share")


DRAWDOWN = """dd AS (SELECT strategy, min(least(0, e - greatest(0, p))) AS fall FROM (SELECT strategy, e,
 max(e) OVER (PARTITION BY strategy ORDER BY date, event ROWS UNBOUNDED PRECEDING) AS p FROM (SELECT *,
 sum(pnl) OVER (PARTITION BY strategy ORDER BY date, event ROWS UNBOUNDED PRECEDING) AS e FROM evt)) GROUP BY strategy)"""


@query("drawdown", "E9", f"WITH {RET}, {DRAWDOWN} SELECT strategy, {six('fall')} AS max_drawdown FROM dd")
def drawdown(spark, d):
    out = max_drawdown(event_returns(spark, d), ["strategy"], ["date", "event"], "pnl", F.unix_date("date"))
    return tidy(out, "max_drawdown")


def draws_sql(seed: int, value: str, draws: int = DRAWS) -> str:
    """Resampled sums with the same seeded integer arithmetic."""
    return f"""smp AS (SELECT *, count(*) OVER (PARTITION BY strategy) AS n,
 row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS p FROM perd),
slot AS (SELECT s.strategy, s.n, d.draw, s.p AS slot, (d.draw * {ev.DRAW_A} + s.p * {ev.DRAW_B} + {seed * ev.DRAW_SEED}) % {ev.DRAW_MODULUS} AS a
 FROM smp s, (SELECT unnest(generate_series(1, {draws}))::BIGINT AS draw) d),
pick AS (SELECT strategy, draw, n, (((b * b + draw) % {ev.DRAW_MODULUS}) % n) AS p FROM (SELECT *, (a * a + slot) % {ev.DRAW_MODULUS} AS b FROM slot)),
boot AS (SELECT k.strategy, k.draw, k.n, sum(s.pnl) AS pnl, sum(s.capital) AS capital, avg({value}) AS m
 FROM pick k JOIN smp s ON s.strategy = k.strategy AND s.p = k.p GROUP BY ALL)"""


LOW, HIGH = int(0.025 * DRAWS), int(0.975 * DRAWS) - 1
INTERVAL = f"""ci AS (SELECT strategy, list_sort(list(m))[{LOW + 1}] AS lo, list_sort(list(m))[{HIGH + 1}] AS hi
 FROM boot GROUP BY strategy)"""


@query("bootstrap_mean", "D12 J4", f"WITH {RET}, {draws_sql(7, 's.pnl')}, {INTERVAL} SELECT strategy, {six('lo')} AS ci_low, {six('hi')} AS ci_high FROM ci")
def bootstrap_mean(spark, d):
    return tidy(ev.bootstrap_mean_interval(per_date(spark, d), ["strategy"], "pnl"), "ci_low", "ci_high")


@query("date_block_bootstrap", "D13", f"""WITH {RET}, {draws_sql(11, 's.pnl / s.capital')}, {INTERVAL}
SELECT strategy, {six('lo')} AS ci_low, {six('hi')} AS ci_high FROM ci""")
def date_block_bootstrap(spark, d):
    return tidy(ev.date_block_interval(event_returns(spark, d), ["strategy"]), "ci_low", "ci_high")


RATIO = """rb AS (SELECT strategy, quantile_cont(pnl, 0.025) AS pl, quantile_cont(pnl, 0.975) AS ph,
 quantile_cont(pnl / capital, 0.025) AS rl, quantile_cont(pnl / capital, 0.975) AS rh, avg((pnl <= 0)::INT) AS pn
 FROM boot GROUP BY strategy)"""


@query("ratio_bootstrap", "D14", f"""WITH {RET}, {draws_sql(13, 's.pnl', RATIO_DRAWS)}, {RATIO} SELECT strategy, {six('pl')} AS pnl_low,
 {six('ph')} AS pnl_high, {six('rl')} AS roi_low, {six('rh')} AS roi_high, {six('pn')} AS p_not_positive FROM rb""")
def ratio_bootstrap(spark, d):
    out = ev.ratio_bootstrap(per_date(spark, d), ["strategy"])
    return tidy(out, "pnl_low", "pnl_high", "roi_low", "roi_high", "p_not_positive")


VERDICT = f"""val AS (SELECT strategy, count(*) AS events, count(*) FILTER (pnl > 0) AS wins, sum(pnl) AS net, sum(capital) AS capital,
 avg(pnl / capital) AS mean_roi, count(DISTINCT date) AS dates, count(DISTINCT station) AS stations FROM evt GROUP BY strategy),
verdicts AS (SELECT *, CASE WHEN events < 30 OR dates < 20 OR stations < 2 THEN 'insufficient_data'
 WHEN net <= 0 OR mean_roi <= 0 OR hi <= 0 THEN 'kill' WHEN dates < 50 OR lo <= 0 THEN 'provisional' ELSE 'keep' END AS verdict
 FROM val JOIN ci USING (strategy) JOIN dd USING (strategy))"""


def validation(spark, d):
    return ev.validate(returns(spark, d), ["strategy"], ["event", "station"], F.unix_date("date"))


@query("verdict", "D15", f"""WITH {RET}, {draws_sql(11, 's.pnl / s.capital')}, {INTERVAL}, {DRAWDOWN}, {VERDICT}
SELECT strategy, events, wins, dates, stations, verdict, {six('net')} AS net, {six('mean_roi')} AS mean_roi, {six('lo')} AS ci_low,
 {six('hi')} AS ci_high, {six('fall')} AS max_drawdown, {six('wins / events')} AS win_rate FROM verdicts""")
def verdict(spark, d):
    out = validation(spark, d).drop("losses", "capital", "reason")
    return tidy(out, "net", "mean_roi", "ci_low", "ci_high", "max_drawdown", "win_rate")


@query("strategy_ranking", "F5", f"""WITH {RET}, {draws_sql(11, 's.pnl / s.capital')}, {INTERVAL}, {DRAWDOWN}, {VERDICT}
SELECT strategy, verdict, CAST(row_number() OVER (ORDER BY CASE verdict WHEN 'keep' THEN 3 WHEN 'provisional' THEN 2
 WHEN 'insufficient_data' THEN 1 ELSE 0 END DESC, lo DESC, mean_roi DESC, net DESC) AS BIGINT) AS place FROM verdicts""")
def strategy_ranking(spark, d):
    from pyspark.sql import Window

    ranked = ev.rank_strategies(validation(spark, d))
    order = [F.desc("merit"), F.desc("ci_low"), F.desc("mean_roi"), F.desc("net")]
    # One row per strategy: the single ordered pass is bounded by the number of strategies.
    place = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    return ranked.select("strategy", "verdict", place.alias("place"))


@query("robustness", "D16", f"""WITH {RET}, {BLOCKS.replace('least(7, n)', 'least(4, n)')}, {draws_sql(13, 's.pnl', RATIO_DRAWS)}, {RATIO},
bb AS (SELECT strategy, count(*) FILTER (p > 0) AS good, count(*) AS all_blocks FROM (SELECT strategy, block, sum(pnl) AS p
 FROM blk GROUP BY ALL) GROUP BY strategy),
lo AS (SELECT strategy, min(w) AS worst, max(t) AS net, max(c) AS dates FROM (SELECT strategy, sum(pnl) OVER w - pnl AS w,
 sum(pnl) OVER w AS t, count(*) OVER w AS c FROM perd WINDOW w AS (PARTITION BY strategy)) GROUP BY strategy)
SELECT strategy, dates, good AS positive_blocks, {six('net')} AS net, {six('worst')} AS worst_without, CASE WHEN dates < 20
 THEN 'INSUFFICIENT_DATES' WHEN good = all_blocks AND worst > 0 AND rl > 0 AND pn <= 0.05 THEN 'ROBUST' ELSE 'NOT_ROBUST' END AS robustness
FROM rb JOIN bb USING (strategy) JOIN lo USING (strategy)""")
def robustness(spark, d):
    out = ev.robustness(per_date(spark, d), ["strategy"])
    return tidy(out.select("strategy", "dates", "positive_blocks", "net", "worst_without", "robustness"), "net", "worst_without")


@query("return_scorecard", "D18", f"""WITH {RET}, {draws_sql(11, 's.pnl / s.capital')}, {INTERVAL}, {DRAWDOWN}, {VERDICT}
SELECT strategy, events, wins, events - wins AS losses, dates, stations, verdict, {six('net')} AS net, {six('capital')} AS capital,
 {six('net / capital')} AS roi, {six('fall')} AS max_drawdown FROM verdicts""")
def return_scorecard(spark, d):
    out = validation(spark, d).withColumn("roi", F.col("net") / F.col("capital"))
    return tidy(
        out.select("strategy", "events", "wins", "losses", "dates", "stations", "verdict", "net", "capital", "roi", "max_drawdown"),
        "net", "capital", "roi", "max_drawdown",
    )
