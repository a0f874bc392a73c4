"""DuckDB SQL of the registered queries, put together from named common table expressions."""

from __future__ import annotations

import re

from alphaloom.functions.expressions import inverse_normal_sql

_DAY = "OVER (PARTITION BY date)"


def _r(x: str, digits: int = 6, name: str | None = None) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name or x}"


def _clip(value: str, median: str, mad: str, multiple: float) -> str:
    return f"CASE WHEN {mad} > 0 THEN greatest(least({value}, {median} + {multiple} * 1.4826 * {mad}), {median} - {multiple} * 1.4826 * {mad}) ELSE {value} END"


def _mad(source: str, value: str, keep: str = "*") -> str:
    return f"(SELECT *, median(abs({value} - med)) {_DAY} AS mad FROM (SELECT {keep}, median({value}) {_DAY} AS med FROM {source}))"


def _standard(value: str, weight: str = "weight") -> str:
    mean = f"(sum({value} * {weight}) {_DAY} / sum({weight}) {_DAY})"
    return f"(({value} - {mean}) / sqrt(sum({weight} * {value} * {value}) {_DAY} / sum({weight}) {_DAY} - {mean} * {mean}))"


def _style(table: str, value: str) -> str:
    """A raw style of ``table``: median fill, clip and standard score by date, null where fewer than two names have it."""
    filled = f"(SELECT s.date, s.ticker, s.weight, count(b.{value}) OVER (PARTITION BY s.date) AS have, coalesce(b.{value}, median(b.{value}) OVER (PARTITION BY s.date)) AS v FROM sized s LEFT JOIN {table} b ON b.date = s.date AND b.ticker = s.ticker WHERE s.date IN (SELECT date FROM betas))"
    return f"SELECT date, ticker, CASE WHEN have >= 2 THEN {_standard('cut')} END AS x FROM (SELECT date, ticker, weight, have, {_clip('v', 'med', 'mad', 8.0)} AS cut FROM {_mad(filled, 'v')})"


def _least_squares(source: str, columns: tuple[str, ...]) -> str:
    """``date`` and a coefficient ``b_<column>`` each, weighted, by orthogonalising the columns in turn and solving backwards."""
    table, done = source, []
    for name in columns:
        minus = "".join(f" - z_{d} * (sum(weight * {name} * z_{d}) {_DAY} / sum(weight * z_{d} * z_{d}) {_DAY})" for d in done)
        table = f"(SELECT *, {name}{minus} AS z_{name} FROM {table})"
        done.append(name)
    parts = [f"sum(weight * y * z_{c}) / sum(weight * z_{c} * z_{c}) AS c_{c}" for c in columns]
    parts += [f"sum(weight * {b} * z_{a}) / sum(weight * z_{a} * z_{a}) AS r_{a}_{b}" for i, a in enumerate(columns) for b in columns[i + 1 :]]
    full = " AND ".join(f"sum(weight * z_{c} * z_{c}) > 1e-12 * sum(weight * {c} * {c})" for c in columns)
    table = f"(SELECT date, {', '.join(parts)} FROM {table} GROUP BY date HAVING {full})"
    for i in reversed(range(len(columns))):
        a, later = columns[i], columns[i + 1 :]
        table = f"(SELECT *, c_{a}{''.join(f' - r_{a}_{b} * b_{b}' for b in later)} AS b_{a} FROM {table})"
    return table


#: name: (needs, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "cells": (
        (),
        "SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS ticker, l_suppkey, strftime(date_trunc('month', l_shipdate), '%Y%m%d') AS date, sum(l_quantity) AS units, round(sum(l_extendedprice), 2) AS cap, round(sum(l_discount), 2) AS off, count(*) AS n FROM lineitem GROUP BY ALL",
    ),
    "panel": (
        ("cells",),
        "SELECT date, ticker, cap / units AS price, (cap / units) / lag(cap / units) OVER t - 1 AS ret, cap, lag(cap) OVER t AS prev_cap, 'R' || CAST(n_regionkey AS VARCHAR) AS industry, -off / n AS prediction, units >= 60 AS tradable "
        "FROM cells JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey WINDOW t AS (PARTITION BY ticker ORDER BY date)",
    ),
    "rets": (("panel",), "SELECT date, ticker, ret FROM panel WHERE ret IS NOT NULL"),
    "bench": (("panel",), f"SELECT date, ticker, prev_cap / sum(prev_cap) {_DAY} AS benchmark_weight FROM panel WHERE prev_cap IS NOT NULL"),
    "wins": (("panel",), f"SELECT date, ticker, prediction, {_clip('prediction', 'med', 'mad', 5.0)} AS w FROM {_mad('panel', 'prediction', 'date, ticker, prediction')}"),
    "ranks": (("wins",), f"SELECT date, ticker, prediction, rank() OVER (PARTITION BY date ORDER BY w) + (count(*) OVER (PARTITION BY date, w) - 1) / 2.0 AS rk, count(*) {_DAY} AS n FROM wins"),
    "uniform": (
        ("ranks",),
        f"SELECT date, ticker, raw_prediction, CASE WHEN stddev_pop(c) {_DAY} > 1e-12 THEN c / stddev_pop(c) {_DAY} END AS signal_score FROM (SELECT date, ticker, prediction AS raw_prediction, rk / n - avg(rk / n) {_DAY} AS c FROM ranks)",
    ),
    "candidates": (("panel",), "SELECT * FROM (SELECT date, ticker, prediction, row_number() OVER (PARTITION BY date ORDER BY prediction DESC, ticker) AS place FROM panel WHERE tradable) WHERE place <= 10"),
    "universe": (("candidates", "bench"), "SELECT date, ticker FROM candidates UNION SELECT date, ticker FROM bench WHERE benchmark_weight > 0"),
    "days": (("panel",), "SELECT date, row_number() OVER (ORDER BY date) - 1 AS ix, lag(date) OVER (ORDER BY date) AS prev_date, lead(date) OVER (ORDER BY date) AS next_date FROM (SELECT DISTINCT date FROM panel)"),
    "common": (("panel", "rets"), "SELECT date, lag(date) OVER (ORDER BY date) AS exposure_date FROM (SELECT date FROM rets INTERSECT SELECT date FROM panel)"),
    "sections": (
        ("common", "rets", "panel"),
        "SELECT * EXCLUDE (cnt) FROM (SELECT r.date, c.exposure_date, r.ticker, r.ret, p.cap, count(*) OVER (PARTITION BY r.date) AS cnt FROM rets r JOIN common c ON r.date = c.date AND c.exposure_date IS NOT NULL "
        "JOIN panel p ON p.date = c.exposure_date AND p.ticker = r.ticker AND p.cap > 0) WHERE cnt >= 5",
    ),
    "sized": (
        ("sections",),
        f"SELECT date, exposure_date, ticker, ret, cap, weight, {_standard('cut')} AS size FROM (SELECT *, {_clip('l', 'med', 'mad', 5.0)} AS cut FROM {_mad('(SELECT *, sqrt(cap) AS weight, ln(cap) AS l FROM sections)', 'l')})",
    ),
    "nl": (
        ("sized",),
        f"SELECT date, ticker, {_standard('cut')} AS nlsize FROM (SELECT date, ticker, weight, {_clip('res', 'med', 'mad', 5.0)} AS cut FROM "
        + _mad(
            f"(SELECT date, ticker, weight, dy - dx * sum(weight * dx * dy) {_DAY} / sum(weight * dx * dx) {_DAY} AS res FROM (SELECT date, ticker, weight, size - sum(weight * size) {_DAY} / sum(weight) {_DAY} AS dx, size ** 3 - sum(weight * size ** 3) {_DAY} / sum(weight) {_DAY} AS dy FROM sized))",
            "res",
        )
        + ")",
    ),
    "rdays": (("rets",), "SELECT date, row_number() OVER (ORDER BY date) - 1 AS ix FROM (SELECT DISTINCT date FROM rets)"),
    "history": (
        ("sections", "rdays", "rets"),
        "SELECT s.date, s.ticker, d.ix AS k, h.ix, r.ret AS r FROM sections s JOIN rdays d ON d.date = s.exposure_date AND d.ix + 1 >= 12 JOIN rdays h ON h.ix BETWEEN d.ix - 23 AND d.ix JOIN rets r ON r.date = h.date AND r.ticker = s.ticker",
    ),
    "market": (("history",), f"SELECT *, m - avg(m) {_DAY} AS c FROM (SELECT date, ix, avg(r) AS m FROM history GROUP BY ALL)"),
    "betas": (
        ("history", "market"),
        "SELECT h.date, h.ticker, count(*) AS n, CASE WHEN count(*) >= 12 AND sum(c * c) > 0 THEN (sum(r * c) - avg(r) * sum(c)) / sum(c * c) END AS beta, "
        "CASE WHEN count(*) FILTER (h.ix <= k - 1 AND r > -1) >= 12 THEN sum(ln(1 + r)) FILTER (h.ix <= k - 1 AND r > -1) END AS momentum FROM history h JOIN market m ON h.date = m.date AND h.ix = m.ix GROUP BY h.date, h.ticker",
    ),
    "vols": (
        ("history", "market", "betas"),
        "SELECT b.date, b.ticker, CASE WHEN any_value(b.n) >= 12 THEN stddev_samp(r - b.beta * m.m) END AS resvol FROM history h JOIN market m ON h.date = m.date AND h.ix = m.ix JOIN betas b ON b.date = h.date AND b.ticker = h.ticker GROUP BY b.date, b.ticker",
    ),
    "styled": (
        ("sized", "nl", "betas", "vols"),
        f"SELECT s.date, s.ticker, s.weight, s.ret, 1.0 AS market, s.size, b.x AS beta, m.x AS momentum, v.x AS resvol, n.nlsize FROM sized s JOIN nl n USING (date, ticker) JOIN ({_style('betas', 'beta')}) b USING (date, ticker) JOIN ({_style('betas', 'momentum')}) m USING (date, ticker) JOIN ({_style('vols', 'resvol')}) v USING (date, ticker) "
        "WHERE b.x IS NOT NULL AND m.x IS NOT NULL AND v.x IS NOT NULL AND n.nlsize IS NOT NULL AND s.size IS NOT NULL",
    ),
    "styledy": (("styled",), f"SELECT * EXCLUDE (med, mad), {_clip('ret', 'med', 'mad', 8.0)} AS y FROM {_mad('styled', 'ret')}"),
    "resp": (("sized",), f"SELECT date, ticker, weight, size, {_clip('ret', 'med', 'mad', 8.0)} AS y FROM {_mad('sized', 'ret')}"),
    "fr": (
        ("resp",),
        "SELECT date, unnest(['MARKET', 'SIZE']) AS factor, unnest([sum(weight * y) / sum(weight), sum(weight * y * size) / sum(weight)]) AS f FROM resp GROUP BY date",
    ),
    "aged": (("fr",), "SELECT date, 0.5 ** (age / 12.0) AS w FROM (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS age FROM (SELECT DISTINCT date FROM fr)) WHERE age < 60"),
    "fcov": (
        ("fr", "aged"),
        "SELECT a.factor AS factor_a, b.factor AS factor_b, sum(a.p * a.c * b.c) / any_value(a.scale) * 12 * CASE WHEN a.factor = b.factor THEN 1.0 ELSE 0.9 END AS covariance "
        "FROM (SELECT date, factor, p, f - sum(p * f) OVER (PARTITION BY factor) AS c, scale FROM (SELECT fr.*, w / sw AS p, 1 - sw2 / (sw * sw) AS scale FROM fr JOIN aged USING (date), (SELECT sum(w) AS sw, sum(w * w) AS sw2 FROM aged))) a "
        "JOIN (SELECT date, factor, f - sum(p * f) OVER (PARTITION BY factor) AS c FROM (SELECT fr.*, w / sw AS p FROM fr JOIN aged USING (date), (SELECT sum(w) AS sw FROM aged))) b USING (date) GROUP BY 1, 2",
    ),
    "spec": (
        ("resp", "fr", "aged"),
        "SELECT ticker, greatest(0.9 * v + 0.1 * median(v) OVER (), 1e-6) AS specific_var, observations FROM (SELECT ticker, greatest(sum(w * e * e) / sum(w) * 12, 1e-6) AS v, count(*) AS observations "
        "FROM (SELECT r.date, r.ticker, r.y - m.f - r.size * s.f AS e FROM resp r JOIN fr m ON m.date = r.date AND m.factor = 'MARKET' JOIN fr s ON s.date = r.date AND s.factor = 'SIZE') JOIN aged USING (date) GROUP BY ticker HAVING count(*) >= 12)",
    ),
    "members": (("panel",), "SELECT DISTINCT ticker, industry FROM panel"),
    "lastx": (("resp",), "SELECT ticker, size FROM resp WHERE date = (SELECT max(date) FROM resp)"),
    "lastd": (
        ("lastx", "spec", "members"),
        "SELECT x.ticker, coalesce(s.specific_var, i.im, (SELECT median(specific_var) FROM spec)) AS d FROM lastx x JOIN members USING (ticker) LEFT JOIN spec s USING (ticker) "
        "LEFT JOIN (SELECT industry, median(specific_var) AS im FROM spec JOIN members USING (ticker) GROUP BY industry) i USING (industry)",
    ),
    "asdates": (("days",), "SELECT date AS as_of FROM days WHERE ix >= 24 AND ix % 20 = 0"),
    "cdays": (("common",), "SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM common"),
    "alast": (("asdates", "cdays"), "SELECT as_of, max(date) AS last, max(k) AS k FROM asdates JOIN cdays ON date <= as_of GROUP BY as_of"),
    "awin": (("alast", "cdays", "fr"), "SELECT as_of, c.date, row_number() OVER (PARTITION BY as_of ORDER BY c.date DESC) - 1 AS age FROM alast a JOIN cdays c ON c.k <= a.k AND c.k > a.k - 24 WHERE c.date IN (SELECT date FROM fr)"),
    "atarget": (("asdates", "alast", "panel"), "SELECT as_of, t.ticker, q.cap FROM asdates JOIN panel t ON t.date = as_of AND t.tradable JOIN alast USING (as_of) JOIN panel q ON q.date = last AND q.ticker = t.ticker"),
    "aspec": (
        ("awin", "resp", "fr"),
        "SELECT as_of, ticker, greatest(0.9 * v + 0.1 * median(v) OVER (PARTITION BY as_of), 1e-6) AS v FROM (SELECT as_of, r.ticker, greatest(sum(0.5 ** (age / 12.0) * (r.y - m.f - r.size * s.f) ** 2) / sum(0.5 ** (age / 12.0)) * 12, 1e-6) AS v "
        "FROM awin JOIN resp r USING (date) JOIN fr m ON m.date = r.date AND m.factor = 'MARKET' JOIN fr s ON s.date = r.date AND s.factor = 'SIZE' GROUP BY as_of, r.ticker HAVING count(*) >= 12)",
    ),
    "moving": (("panel",), "SELECT date, ticker, CASE WHEN ticker LIKE '%3' AND date >= '19970301' THEN 'R9' ELSE industry END AS code FROM panel"),
    "ireg": (
        ("resp", "common", "moving"),
        "SELECT *, sum(weight * (size - mx) * (y - my)) OVER (PARTITION BY date) / sum(weight * (size - mx) * (size - mx)) OVER (PARTITION BY date) AS b FROM (SELECT r.*, m.code, sum(weight * size) OVER g / sum(weight) OVER g AS mx, sum(weight * y) OVER g / sum(weight) OVER g AS my "
        "FROM resp r JOIN common c ON c.date = r.date JOIN moving m ON m.date = c.exposure_date AND m.ticker = r.ticker WINDOW g AS (PARTITION BY r.date, m.code))",
    ),
    "ifr": (("ireg",), "SELECT date, 'SIZE' AS factor, any_value(b) AS f FROM ireg GROUP BY date UNION ALL SELECT date, 'INDUSTRY:' || code, any_value(my - b * mx) FROM ireg GROUP BY date, code"),
    "iseen": (("alast", "cdays", "ireg"), "SELECT as_of, c.date, i.code FROM alast a JOIN cdays c ON c.k <= a.k AND c.k > a.k - 24 JOIN (SELECT DISTINCT date, code FROM ireg) i ON i.date = c.date"),
    "iwin": (
        ("iseen",),
        "SELECT as_of, date, row_number() OVER (PARTITION BY as_of ORDER BY date DESC) - 1 AS age FROM (SELECT as_of, date, count(*) AS n FROM iseen GROUP BY ALL) JOIN (SELECT as_of, count(DISTINCT code) AS wanted FROM iseen GROUP BY as_of) USING (as_of) WHERE n = wanted",
    ),
    "ispec": (
        ("iwin", "ireg"),
        "SELECT as_of, ticker, greatest(0.9 * v + 0.1 * median(v) OVER (PARTITION BY as_of), 1e-6) AS v FROM (SELECT as_of, ticker, greatest(sum(0.5 ** (age / 12.0) * (y - (my - b * mx) - size * b) ** 2) / sum(0.5 ** (age / 12.0)) * 12, 1e-6) AS v "
        "FROM iwin JOIN ireg USING (date) GROUP BY as_of, ticker HAVING count(*) >= 12)",
    ),
    "iplaced": (
        ("asdates", "panel"),
        "SELECT as_of, ticker, CASE WHEN ticker LIKE '%3' AND as_of >= '19970301' THEN 'R9' ELSE industry END AS code FROM asdates, (SELECT ticker, industry, min(date) AS since FROM panel GROUP BY ALL) WHERE since <= as_of",
    ),
    "lines": (
        (),
        "SELECT date, len(o) || ':' || o AS o, len(n) || ':' || n AS n, len(u) || ':' || u AS u, len(c) || ':' || c AS c, len(f) || ':' || f AS f, u::BIGINT AS units, f::BIGINT AS off, n::INT AS number FROM (SELECT strftime(date_trunc('month', l_shipdate), '%Y%m%d') AS date, "
        "l_orderkey::VARCHAR AS o, l_linenumber::VARCHAR AS n, round(l_quantity * 100)::BIGINT::VARCHAR AS u, round(l_extendedprice * 100)::BIGINT::VARCHAR AS c, round(l_discount * 100)::BIGINT::VARCHAR AS f FROM lineitem)",
    ),
    "keyed": (("lines",), "SELECT *, md5(c || '8:' || date || n || o || f || u) AS h FROM lines"),
    "wide_dates": (("days",), "SELECT date AS as_of, ix FROM days WHERE ix >= 24 AND ix % 10 = 4"),
    "wide_targets": (("wide_dates", "panel"), "SELECT as_of, ix, ticker FROM wide_dates JOIN panel ON date = as_of AND tradable"),
    "psize": (("panel",), f"SELECT date, ticker, (ln(cap) - avg(ln(cap)) {_DAY}) / stddev_pop(ln(cap)) {_DAY} AS x FROM panel"),
    "active": (
        ("book", "psize"),
        "SELECT date, portfolio, 'INDUSTRY:' || industry AS factor, 'INDUSTRY' AS family, sum(tw) - sum(bw) AS a FROM book GROUP BY ALL UNION ALL SELECT date, portfolio, 'SIZE', 'STYLE', sum((tw - bw) * x) FROM book JOIN psize USING (date, ticker) GROUP BY date, portfolio",
    ),
    "resolved": (
        ("active",),
        "SELECT date, factor, lower, upper, level FROM (SELECT *, row_number() OVER (PARTITION BY f.date, f.factor ORDER BY rank DESC) AS k FROM (SELECT DISTINCT date, factor, family FROM active) f JOIN (VALUES ('INDUSTRY', NULL, NULL, -0.2, 0.2, true, 'family', 0), ('INDUSTRY', NULL, '19980101', -0.3, 0.3, true, 'family on a date', 1), "
        "('INDUSTRY', 'INDUSTRY:R1', NULL, -0.05, 0.1, true, 'factor', 2), ('INDUSTRY', 'INDUSTRY:R2', '19980101', -0.02, 0.02, true, 'factor on a date', 3), ('INDUSTRY', 'INDUSTRY:R3', '19980401', NULL, NULL, false, 'factor on a date', 3), ('STYLE', 'SIZE', NULL, -0.05, 0.25, true, 'factor', 2)) "
        "v(fam, fac, dat, lower, upper, enabled, level, rank) ON v.fam = f.family AND (v.fac IS NULL OR v.fac = f.factor) AND (v.dat IS NULL OR v.dat = f.date)) WHERE k = 1 AND enabled",
    ),
    "grid": (("panel",), "SELECT date, ticker, coalesce(ret, 0.0) AS r FROM (SELECT * FROM (SELECT DISTINCT date FROM panel), (SELECT DISTINCT ticker FROM panel)) LEFT JOIN panel USING (date, ticker)"),
    "rebal": (("bench", "panel"), "SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS ix FROM (SELECT DISTINCT date FROM bench)) WHERE ix % 3 = 0 AND date < (SELECT max(date) FROM panel)"),
    "scored": (("uniform", "bench", "rebal"), "SELECT * FROM uniform JOIN bench USING (date, ticker) JOIN rebal USING (date)"),
    "targets": (
        ("scored", "bench", "rebal"),
        f"SELECT date, ticker, 'equal_weight_signal' AS portfolio, 1.0 / least(10, n) AS target_weight FROM (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY signal_score DESC, ticker) AS place, count(*) {_DAY} AS n FROM scored) WHERE place <= 10 "
        f"UNION ALL SELECT date, ticker, 'tilt', signal_score / sum(signal_score) {_DAY} FROM scored WHERE signal_score > 0 "
        "UNION ALL SELECT date, ticker, 'benchmark', benchmark_weight FROM bench JOIN rebal USING (date)",
    ),
    "spans": (
        ("targets", "days"),
        "SELECT t.portfolio, t.ticker, t.target_weight, s.start, s.stop FROM targets t JOIN (SELECT portfolio, date, start, lead(start) OVER (PARTITION BY portfolio ORDER BY start) AS stop FROM (SELECT DISTINCT portfolio, date, next_date AS start FROM targets JOIN days USING (date))) s USING (portfolio, date)",
    ),
    "held": (
        ("spans", "grid"),
        "SELECT portfolio, start, date, ticker, target_weight, target_weight * product(1 + r) OVER (PARTITION BY portfolio, start, ticker ORDER BY date) AS value FROM spans JOIN grid USING (ticker) WHERE date >= start AND (stop IS NULL OR date < stop) AND target_weight <> 0",
    ),
    "drift": (("held",), "SELECT portfolio, start, date, ticker, value / sum(value) OVER (PARTITION BY portfolio, date) AS weight FROM held"),
    "gross": (
        ("held",),
        "SELECT portfolio, start, date, v / coalesce(lag(v) OVER (PARTITION BY portfolio, start ORDER BY date), t) - 1 AS gross_return FROM (SELECT portfolio, start, date, sum(value) AS v, sum(target_weight) AS t FROM held GROUP BY ALL)",
    ),
    "moved": (
        ("spans", "drift", "days"),
        "SELECT portfolio, date, CASE WHEN bool_or(known) THEN sum(abs(coalesce(tw, 0) - coalesce(ow, 0))) / 2 ELSE 0.0 END AS turnover FROM ("
        "SELECT coalesce(n.portfolio, o.portfolio) AS portfolio, coalesce(n.date, o.date) AS date, n.tw, o.ow, o.ow IS NOT NULL AS known FROM (SELECT portfolio, start AS date, ticker, target_weight AS tw FROM spans) n "
        "FULL JOIN (SELECT d.portfolio, s.start AS date, d.ticker, d.weight AS ow FROM drift d JOIN (SELECT DISTINCT portfolio, start FROM spans) s USING (portfolio) JOIN days y ON y.date = s.start AND y.prev_date = d.date) o "
        "ON n.portfolio = o.portfolio AND n.date = o.date AND n.ticker = o.ticker) GROUP BY portfolio, date",
    ),
    "daily": (
        ("gross", "moved"),
        "SELECT date, portfolio, gross_return, transaction_cost, net_return, turnover, nav, nav / greatest(1.0, max(nav) OVER w) - 1 AS drawdown FROM (SELECT *, product(1 + net_return) OVER (PARTITION BY portfolio ORDER BY date) AS nav FROM ("
        "SELECT g.date, g.portfolio, gross_return, coalesce(turnover, 0) AS turnover, coalesce(turnover, 0) * 0.001 AS transaction_cost, gross_return - coalesce(turnover, 0) * 0.001 AS net_return FROM gross g LEFT JOIN moved m ON g.portfolio = m.portfolio AND g.date = m.date)) "
        "WINDOW w AS (PARTITION BY portfolio ORDER BY date)",
    ),
    "relative": (
        ("daily",),
        "SELECT *, active_nav / max(active_nav) OVER (PARTITION BY portfolio ORDER BY date) - 1 AS active_drawdown FROM (SELECT d.*, b.net_return AS benchmark_net_return, d.net_return - b.net_return AS active_return, d.nav / b.nav AS active_nav FROM daily d LEFT JOIN daily b ON b.portfolio = 'benchmark' AND b.date = d.date)",
    ),
    "book": (
        ("targets", "bench", "panel", "candidates"),
        "SELECT h.date, h.portfolio, b.ticker, coalesce(t.target_weight, 0) AS tw, b.benchmark_weight AS bw, p.tradable, p.industry, c.ticker IS NOT NULL AS cand FROM (SELECT DISTINCT date, portfolio FROM targets WHERE portfolio <> 'benchmark') h JOIN bench b USING (date) "
        "JOIN panel p ON p.date = h.date AND p.ticker = b.ticker LEFT JOIN targets t ON t.date = h.date AND t.portfolio = h.portfolio AND t.ticker = b.ticker LEFT JOIN candidates c ON c.date = h.date AND c.ticker = b.ticker",
    ),
}

_SWEPT = ("targets", "spans", "held", "drift", "gross", "moved", "daily")


def _swept(text: str) -> str:
    """A backtest's table for the sweep's portfolios, which differ in cost too."""
    text = re.sub(rf"\b(?<!\.)({'|'.join(_SWEPT)})\b(?! AS )", r"v\1", text)
    return text.replace("* 0.001", "* (CASE WHEN g.portfolio = 'costly' THEN 0.005 WHEN g.portfolio = 'benchmark' THEN 0.0 ELSE 0.001 END)")


CTES |= {f"v{n}": (tuple(f"v{x}" if x in _SWEPT else x for x in CTES[n][0]), _swept(CTES[n][1])) for n in _SWEPT[1:]}
CTES["vtargets"] = (
    ("scored", "bench", "rebal"),
    "SELECT date, ticker, name AS portfolio, 1.0 / n AS target_weight FROM (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY signal_score DESC, ticker) AS place FROM scored) JOIN (VALUES ('base', 10), ('small', 5), ('skewed', 10), ('costly', 10)) v(name, n) ON place <= n "
    "UNION ALL SELECT date, ticker, 'benchmark', benchmark_weight FROM bench JOIN rebal USING (date)",
)

#: name: (needs, final select)
FINALS: dict[str, tuple[tuple[str, ...], str]] = {
    "calibrate_uniform": (("uniform",), f"SELECT date, ticker, raw_prediction, {_r('signal_score')}, {_r('signal_score * 0.05', name='expected_return')} FROM uniform"),
    "calibrate_power": (
        ("ranks",),
        f"SELECT date, ticker, prediction AS raw_prediction, {_r(f'c / stddev_pop(c) {_DAY}', name='signal_score')}, {_r(f'c / stddev_pop(c) {_DAY} * 0.05', name='expected_return')} FROM (SELECT *, x - avg(x) {_DAY} AS c FROM (SELECT *, sign((rk - 0.5) / n - 0.5) * abs((rk - 0.5) / n - 0.5) ** 2.0 AS x FROM ranks))",
    ),
    "calibrate_normal": (
        ("ranks",),
        f"SELECT date, ticker, prediction AS raw_prediction, {_r(f'c / stddev_pop(c) {_DAY}', name='signal_score')}, {_r(f'c / stddev_pop(c) {_DAY} * 0.05', name='expected_return')} FROM (SELECT *, x - avg(x) {_DAY} AS c FROM (SELECT *, {inverse_normal_sql('pos')} AS x FROM (SELECT *, (rk - 0.5) / n AS pos FROM ranks)))",
    ),
    "calibrate_expected_return": (("panel",), f"SELECT date, ticker, prediction AS raw_prediction, {_r(f'(-prediction - avg(-prediction) {_DAY}) / stddev_pop(-prediction) {_DAY}', name='signal_score')}, {_r('-prediction', name='expected_return')} FROM panel"),
    "mad_winsorize": (("rets",), f"SELECT date, ticker, {_r('w', name='winsorized')}, w <> ret AS changed FROM (SELECT *, {_clip('ret', 'med', 'mad', 5.0)} AS w FROM {_mad('rets', 'ret')})"),
    "signal_summary": (
        ("uniform",),
        f"SELECT date, count(signal_score) AS n, {_r('min(signal_score)', name='minimum')}, {_r('max(signal_score)', name='maximum')}, {_r('avg(signal_score)', name='mean')}, {_r('stddev_pop(signal_score)', name='deviation')}, {_r('median(signal_score)', name='median')} FROM uniform GROUP BY date",
    ),
    "top_candidates": (("candidates",), "SELECT date, ticker, prediction, place FROM candidates"),
    "rebalance_calendar": (("panel",), "SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS ix FROM (SELECT DISTINCT date FROM panel WHERE date >= '19990101')) WHERE ix % 3 = 0"),
    "signal_quality": (
        ("panel",),
        "SELECT count(*) AS n_rows, count(*) FILTER (ticker IS NULL OR trim(ticker) = '') AS bad_keys, count(*) FILTER (prediction IS NULL OR NOT isfinite(prediction)) AS bad_values, count(*) - count(DISTINCT (date, ticker)) AS duplicates, count(DISTINCT date) AS n_dates, count(*) FILTER (tradable) AS n_tradable FROM panel",
    ),
    "benchmark_renormalize": (
        ("bench", "panel"),
        f"SELECT date, ticker, {_r(f'benchmark_weight / sum(benchmark_weight) {_DAY}', 8, 'benchmark_weight')}, {_r(f'sum(benchmark_weight) {_DAY}', 8, 'retained')} FROM bench JOIN panel USING (date, ticker) WHERE tradable AND benchmark_weight > 0",
    ),
    "benchmark_excluded": (("bench", "panel"), f"SELECT date, count(*) AS n_excluded, {_r('sum(benchmark_weight)', 8, 'excluded_weight')} FROM bench JOIN panel USING (date, ticker) WHERE NOT tradable AND benchmark_weight > 0 GROUP BY date"),
    "optimizer_universe": (("universe",), "SELECT date, ticker FROM universe"),
    "coverage_by_date": (
        ("panel", "candidates", "bench", "universe"),
        "SELECT date, count(*) AS n_signal, coalesce(any_value(c.n), 0) AS n_candidates, coalesce(any_value(b.n), 0) AS n_benchmark, coalesce(any_value(u.n), 0) AS n_universe FROM panel LEFT JOIN (SELECT date, count(*) AS n FROM candidates GROUP BY date) c USING (date) "
        "LEFT JOIN (SELECT date, count(*) AS n FROM bench WHERE benchmark_weight > 0 GROUP BY date) b USING (date) LEFT JOIN (SELECT date, count(*) AS n FROM universe GROUP BY date) u USING (date) GROUP BY date",
    ),
    "store_returns": (("panel",), f"SELECT date, ticker, {_r('ret', name='return')}, cap, tradable FROM panel"),
    "terminal_returns": (
        ("rets",),
        f"SELECT date, ticker, {_r('ret', name='return')}, terminal FROM (SELECT date, ticker, ret, false AS terminal FROM rr UNION ALL SELECT nd, ticker, -1.0, true FROM (SELECT ticker, max(date) AS date FROM rr GROUP BY ticker) JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM rr)) USING (date) WHERE date <= '20031231' AND nd IS NOT NULL)",
    ),
    "existing_experiment": (
        ("panel",),
        f"SELECT date, ticker, prediction AS alpha_score, {_r(f'1.0 / count(*) {_DAY}', 8, 'benchmark_weight')} FROM panel WHERE ticker IN (SELECT ticker FROM panel WHERE cap > 500000)",
    ),
    "industry_asof": (("panel",), "SELECT p.date, p.ticker, h.industry FROM panel p JOIN (SELECT ticker, industry, min(date) AS i FROM panel GROUP BY ALL) h ON h.ticker = p.ticker AND p.date BETWEEN h.i AND '99991231'"),
    "industry_overlap": (
        ("panel",),
        "SELECT * FROM (SELECT *, lag(out_date) OVER (PARTITION BY ticker ORDER BY in_date, out_date) AS earlier_end FROM (SELECT ticker, industry, min(date) AS in_date, '99991231' AS out_date FROM panel GROUP BY ALL UNION ALL SELECT ticker, industry, max(date), '99991231' FROM panel WHERE tradable GROUP BY ALL)) WHERE in_date <= earlier_end",
    ),
    "size_exposure": (("sized",), f"SELECT date, exposure_date, ticker, {_r('weight')}, {_r('size')} FROM sized"),
    "nlsize_exposure": (("nl",), f"SELECT date, ticker, {_r('nlsize', 5)} FROM nl"),
    "return_styles": (("betas", "vols"), f"SELECT date, ticker, {_r('beta', 5)}, {_r('resvol', 5)}, {_r('momentum', 5)} FROM betas JOIN vols USING (date, ticker)"),
    "standardized_beta": (
        ("sized", "betas"),
        f"SELECT date, ticker, {_r(_standard('cut'), 5, 'beta')} FROM (SELECT date, ticker, weight, {_clip('v', 'med', 'mad', 8.0)} AS cut FROM "
        + _mad(f"(SELECT s.date, s.ticker, s.weight, coalesce(b.beta, median(b.beta) OVER (PARTITION BY s.date)) AS v FROM sized s LEFT JOIN betas b ON b.date = s.date AND b.ticker = s.ticker WHERE s.date IN (SELECT date FROM betas))", "v")
        + ")",
    ),
    "factor_returns_market_size": (("fr",), f"SELECT date, factor, {_r('f', name='factor_return')} FROM fr"),
    "factor_returns_wls": (
        ("styledy",),
        "SELECT date, unnest(['MARKET', 'SIZE', 'BETA', 'MOMENTUM', 'RESVOL', 'NLSIZE']) AS factor, round(unnest([b_market, b_size, b_beta, b_momentum, b_resvol, b_nlsize]), 6) + 0.0 AS factor_return FROM "
        + _least_squares("styledy", ("market", "size", "beta", "momentum", "resvol", "nlsize")),
    ),
    "factor_returns_industry": (
        ("resp", "sections", "members"),
        "SELECT date, unnest(['SIZE', 'INDUSTRY:R0', 'INDUSTRY:R1', 'INDUSTRY:R2', 'INDUSTRY:R3', 'INDUSTRY:R4']) AS factor, round(unnest([b, r0, r1, r2, r3, r4]), 6) + 0.0 AS factor_return FROM (SELECT date, any_value(b) AS b, "
        + ", ".join(f"max(my - b * mx) FILTER (industry = 'R{i}') AS r{i}" for i in range(5))
        + ", count(DISTINCT industry) AS n FROM (SELECT *, sum(weight * (size - mx) * (y - my)) OVER (PARTITION BY date) / sum(weight * (size - mx) * (size - mx)) OVER (PARTITION BY date) AS b FROM (SELECT *, sum(weight * size) OVER g / sum(weight) OVER g AS mx, sum(weight * y) OVER g / sum(weight) OVER g AS my FROM resp JOIN members USING (ticker) WINDOW g AS (PARTITION BY date, industry))) GROUP BY date) WHERE n = 5",
    ),
    "ewma_factor_covariance": (("fcov",), f"SELECT factor_a, factor_b, {_r('covariance')} FROM fcov"),
    "covariance_repair": (("fcov",), f"SELECT factor_a, factor_b, {_r('covariance')} FROM fcov"),
    "specific_variance": (("spec",), f"SELECT ticker, {_r('specific_var')}, observations FROM spec"),
    "specific_impute": (
        ("spec", "members"),
        f"SELECT m.ticker, {_r('coalesce(s.specific_var, i.im, (SELECT median(specific_var) FROM k))', name='specific_var')}, s.specific_var IS NULL AS imputed FROM members m LEFT JOIN k s USING (ticker) LEFT JOIN (SELECT industry, median(specific_var) AS im FROM k JOIN members USING (ticker) GROUP BY industry) i USING (industry)",
    ),
    "asset_covariance": (
        ("lastx", "lastd", "fcov"),
        f"SELECT a.ticker AS row_ticker, b.ticker AS col_ticker, {_r('mm + (a.size + b.size) * ms + a.size * b.size * ss + CASE WHEN a.ticker = b.ticker THEN d ELSE 0 END', name='covariance')} FROM lastx a, lastx b, (SELECT sum(covariance) FILTER (factor_a = 'MARKET' AND factor_b = 'MARKET') AS mm, sum(covariance) FILTER (factor_a = 'MARKET' AND factor_b = 'SIZE') AS ms, sum(covariance) FILTER (factor_a = 'SIZE' AND factor_b = 'SIZE') AS ss FROM fcov) JOIN lastd ON lastd.ticker = a.ticker",
    ),
    "portfolio_metrics": (
        ("lastx", "lastd", "fcov", "resp", "bench", "uniform"),
        f"SELECT portfolio, {_r('mu', name='expected_return')}, {_r('amu', name='active_expected_return')}, {_r('v', name='variance')}, {_r('sqrt(v)', name='volatility')}, {_r('t', name='tracking_variance')}, {_r('sqrt(t)', name='tracking_error')} FROM (SELECT portfolio, sum(w * mu) AS mu, sum((w - b) * mu) AS amu, "
        + ", ".join(f"greatest(sum({w}) ** 2 * any_value(mm) + 2 * sum({w}) * sum({w} * size) * any_value(ms) + sum({w} * size) ** 2 * any_value(ss) + sum(d * {w} ** 2), 0) AS {n}" for w, n in (("w", "v"), ("(w - b)", "t")))
        + " FROM (SELECT ticker, size, b / sum(b) OVER () AS b, mu, unnest(['equal', 'large']) AS portfolio, unnest([1.0 / count(*) OVER (), greatest(size, 0) / sum(greatest(size, 0)) OVER ()]) AS w FROM (SELECT x.ticker, x.size, n.benchmark_weight AS b, 0.05 * u.signal_score AS mu "
        "FROM lastx x JOIN bench n ON n.ticker = x.ticker AND n.date = (SELECT max(date) FROM resp) JOIN uniform u ON u.ticker = x.ticker AND u.date = n.date)) JOIN lastd USING (ticker), "
        "(SELECT sum(covariance) FILTER (factor_a = 'MARKET' AND factor_b = 'MARKET') AS mm, sum(covariance) FILTER (factor_a = 'MARKET' AND factor_b = 'SIZE') AS ms, sum(covariance) FILTER (factor_a = 'SIZE' AND factor_b = 'SIZE') AS ss FROM fcov) GROUP BY portfolio)",
    ),
    "portfolio_risk": (
        ("lastx", "lastd", "fcov"),
        f"SELECT portfolio, {_r('fv', name='factor_variance')}, {_r('sv', name='specific_variance')}, {_r('fv + sv', name='variance')}, {_r('sqrt(fv + sv)', name='volatility')} FROM (SELECT portfolio, sum(w) ** 2 * any_value(mm) + 2 * sum(w) * sum(w * size) * any_value(ms) + sum(w * size) ** 2 * any_value(ss) AS fv, sum(d * w * w) AS sv FROM ("
        "SELECT 'equal' AS portfolio, ticker, size, 1.0 / count(*) OVER () AS w FROM lastx UNION ALL SELECT 'large', ticker, size, greatest(size, 0) / sum(greatest(size, 0)) OVER () FROM lastx) JOIN lastd USING (ticker), "
        "(SELECT sum(covariance) FILTER (factor_a = 'MARKET' AND factor_b = 'MARKET') AS mm, sum(covariance) FILTER (factor_a = 'MARKET' AND factor_b = 'SIZE') AS ms, sum(covariance) FILTER (factor_a = 'SIZE' AND factor_b = 'SIZE') AS ss FROM fcov) GROUP BY portfolio)",
    ),
    "risk_asof_exposures": (
        ("atarget",),
        f"SELECT as_of, ticker, unnest(['MARKET', 'SIZE']) AS factor, round(unnest([1.0, {_standard('cut').replace('date', 'as_of')}]), 6) + 0.0 AS exposure FROM (SELECT *, {_clip('l', 'med', 'mad', 5.0)} AS cut FROM {_mad('(SELECT *, sqrt(cap) AS weight, ln(cap) AS l FROM atarget)', 'l').replace('date', 'as_of')})",
    ),
    "risk_asof_covariance": (
        ("awin", "fr"),
        f"SELECT as_of, a.factor AS factor_a, b.factor AS factor_b, {_r('(sum(w * a.f * b.f) / sum(w) - sum(w * a.f) * sum(w * b.f) / sum(w) ** 2) / (1 - sum(w * w) / sum(w) ** 2) * 12 * CASE WHEN a.factor = b.factor THEN 1.0 ELSE 0.9 END', name='covariance')} FROM (SELECT *, 0.5 ** (age / 12.0) AS w FROM awin) JOIN fr a USING (date) JOIN fr b USING (date) GROUP BY as_of, a.factor, b.factor",
    ),
    "risk_asof_specific": (
        ("atarget", "aspec", "members"),
        f"SELECT as_of, ticker, {_r('greatest(coalesce(s.v, i.im, g.gm), 1e-6)', name='specific_var')}, s.v IS NULL AS imputed FROM atarget JOIN members USING (ticker) LEFT JOIN aspec s USING (as_of, ticker) "
        "LEFT JOIN (SELECT as_of, industry, median(v) AS im FROM aspec JOIN members USING (ticker) GROUP BY as_of, industry) i USING (as_of, industry) LEFT JOIN (SELECT as_of, median(v) AS gm FROM aspec GROUP BY as_of) g USING (as_of)",
    ),
    "risk_asof_periods": (("awin",), "SELECT as_of, count(*) AS periods, min(date) AS first, max(date) AS last FROM awin GROUP BY as_of"),
    "risk_asof_industry_exposures": (
        ("atarget", "iplaced"),
        f"SELECT as_of, ticker, unnest(['SIZE', 'INDUSTRY:' || code]) AS factor, round(unnest([size, 1.0]), 6) + 0.0 AS exposure FROM (SELECT as_of, ticker, {_standard('cut').replace('date', 'as_of')} AS size FROM (SELECT *, {_clip('l', 'med', 'mad', 5.0)} AS cut FROM {_mad('(SELECT *, sqrt(cap) AS weight, ln(cap) AS l FROM atarget)', 'l').replace('date', 'as_of')})) JOIN iplaced USING (as_of, ticker)",
    ),
    "risk_asof_industry_covariance": (
        ("iwin", "ifr"),
        f"SELECT as_of, a.factor AS factor_a, b.factor AS factor_b, {_r('(sum(w * a.f * b.f) / sum(w) - sum(w * a.f) * sum(w * b.f) / sum(w) ** 2) / (1 - sum(w * w) / sum(w) ** 2) * 12 * CASE WHEN a.factor = b.factor THEN 1.0 ELSE 0.9 END', name='covariance')} FROM (SELECT *, 0.5 ** (age / 12.0) AS w FROM iwin) JOIN ifr a USING (date) JOIN ifr b USING (date) GROUP BY as_of, a.factor, b.factor",
    ),
    "risk_asof_industry_specific": (
        ("atarget", "ispec", "iplaced"),
        f"SELECT as_of, ticker, {_r('greatest(coalesce(s.v, i.im, g.gm), 1e-6)', name='specific_var')}, s.v IS NULL AS imputed FROM atarget JOIN iplaced USING (as_of, ticker) LEFT JOIN ispec s USING (as_of, ticker) "
        "LEFT JOIN (SELECT as_of, code, median(v) AS im FROM ispec JOIN iplaced USING (as_of, ticker) GROUP BY as_of, code) i USING (as_of, code) LEFT JOIN (SELECT as_of, median(v) AS gm FROM ispec GROUP BY as_of) g USING (as_of)",
    ),
    "changed_dates": (
        ("keyed",),
        "SELECT date, CASE WHEN b.date IS NULL THEN 'added' WHEN a.date IS NULL THEN 'removed' WHEN (b.n, b.x, b.s) <> (a.n, a.x, a.s) THEN 'changed' ELSE 'same' END AS state, coalesce(b.n, 0) AS rows_before, coalesce(a.n, 0) AS rows_after FROM "
        + " FULL JOIN ".join(
            f"(SELECT date, count(*) AS n, bit_xor(('0x' || h[1:15])::BIGINT) AS x, sum(('0x' || h[16:30])::BIGINT) AS s FROM keyed WHERE {where} GROUP BY date) {name}"
            for where, name in (("date < '19980601' AND NOT (number = 7 AND units >= 4900 AND off >= 10)", "b"), ("date >= '19960701'", "a"))
        )
        + " USING (date)",
    ),
    "frozen_signal_gate": (
        ("panel", "bench"),
        "SELECT name, round(value, 6) + 0.0 AS value, must_be_zero FROM (SELECT unnest(['invalid_tickers', 'invalid_predictions', 'duplicate_keys', 'signal_rows', 'eligibility_duplicates', 'eligibility_invalid', 'eligible_rows', 'no_dates', 'short_dates', 'benchmark_missing_dates', "
        "'benchmark_duplicates', 'benchmark_invalid', 'benchmark_sum_dates', 'benchmark_excluded_dates', 'dates', 'raw_sum_min', 'raw_sum_max', 'raw_deviation_max', 'excluded_count', 'excluded_weight_max', 'universe_min', 'universe_max']) AS name, "
        "unnest([(SELECT count(*) FROM full_signal WHERE ticker IS NULL OR trim(ticker) = ''), (SELECT count(*) FROM full_signal WHERE prediction IS NULL OR NOT isfinite(prediction)), (SELECT count(*) - count(DISTINCT (date, ticker)) FROM full_signal), (SELECT count(*) FROM full_signal), "
        "(SELECT count(*) - count(DISTINCT (date, ticker)) FROM able), (SELECT count(*) FROM able WHERE tradable IS NULL), (SELECT count(*) FROM able WHERE tradable), (SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM chosen), (SELECT count(*) FROM per WHERE n_best < 5), "
        "(SELECT count(*) FROM per WHERE total IS NULL), (SELECT count(*) - count(DISTINCT (date, ticker)) FROM raw), (SELECT count(*) FROM raw WHERE w IS NULL OR NOT isfinite(w) OR w < 0), (SELECT count(*) FROM per WHERE abs(total - 1) > 1e-3), (SELECT count(*) FROM per WHERE lost > 0.5), "
        "(SELECT count(*) FROM per), (SELECT min(total) FROM per), (SELECT max(total) FROM per), (SELECT max(abs(total - 1)) FROM per), (SELECT count(*) FROM pos WHERE NOT known), (SELECT max(lost) FROM per), (SELECT min(n_all) FROM per), (SELECT max(n_all) FROM per)]::DOUBLE[]) AS value, "
        "unnest([true, true, true, false, true, true, false, true, true, true, true, true, true, true, false, false, false, false, false, false, false, false]) AS must_be_zero)",
    ),
    "risk_cache_states": (
        ("wide_targets",),
        "SELECT as_of, count(*) AS names, CASE WHEN count(*) FILTER (ticker NOT IN (SELECT ticker FROM wide_targets WHERE ix = 34)) = 0 THEN 'static_reused' WHEN any_value(ix) % 20 = 4 AND any_value(ix) <> 44 THEN 'dynamic_reused' ELSE 'dynamic_built' END AS source "
        "FROM wide_targets WHERE (ix, ticker) NOT IN (SELECT 44, min(ticker) FROM wide_targets WHERE ix = 44) GROUP BY as_of",
    ),
    "equal_weight_baseline": (("uniform",), f"SELECT date, ticker, {_r('1.0 / least(10, n)', 8, 'target_weight')} FROM (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY signal_score DESC, ticker) AS place, count(*) {_DAY} AS n FROM uniform) WHERE place <= 10"),
    "backtest_daily": (("daily",), f"SELECT date, portfolio, {', '.join(_r(c) for c in ('gross_return', 'transaction_cost', 'net_return', 'turnover', 'nav', 'drawdown'))} FROM daily"),
    "benchmark_relative": (("relative",), f"SELECT date, portfolio, {', '.join(_r(c) for c in ('benchmark_net_return', 'active_return', 'active_nav', 'active_drawdown'))} FROM relative"),
    "index_relative": (
        ("daily", "panel"),
        f"SELECT date, portfolio, {', '.join(_r(c) for c in ('benchmark_net_return', 'active_return', 'active_nav'))}, {_r('active_nav / max(active_nav) OVER (PARTITION BY portfolio ORDER BY date) - 1', name='active_drawdown')} FROM ("
        "SELECT d.date, d.portfolio, i.r AS benchmark_net_return, d.net_return - i.r AS active_return, d.nav / product(1 + i.r) OVER (PARTITION BY d.portfolio ORDER BY d.date) AS active_nav "
        "FROM daily d JOIN (SELECT date, coalesce(avg(ret) FILTER (tradable), 0) AS r FROM panel GROUP BY date) i ON i.date = d.date)",
    ),
    "performance_summary": (
        ("relative",),
        "SELECT portfolio, count(*) AS observations, min(date) AS date_start, max(date) AS date_end, "
        + ", ".join(
            _r(x, 5, n)
            for x, n in (
                ("arg_max(nav, date)", "ending_nav"), ("arg_max(nav, date) ** (12.0 / count(*)) - 1", "annualized_return"), ("stddev_samp(net_return) * sqrt(12)", "annualized_volatility"),
                ("CASE WHEN stddev_samp(net_return) > 1e-15 THEN avg(net_return) / stddev_samp(net_return) * sqrt(12) END", "sharpe"), ("min(drawdown)", "maximum_drawdown"), ("sum(turnover)", "total_turnover"), ("sum(transaction_cost)", "total_cost"),
                ("arg_max(active_nav, date)", "active_ending_nav"), ("arg_max(active_nav, date) ** (12.0 / count(*)) - 1", "annualized_excess_return"), ("stddev_samp(active_return) * sqrt(12)", "tracking_error"),
                ("CASE WHEN stddev_samp(active_return) > 1e-15 THEN avg(active_return) / stddev_samp(active_return) * sqrt(12) END", "information_ratio"), ("min(active_drawdown)", "maximum_active_drawdown"),
            )
        )
        + " FROM relative GROUP BY portfolio",
    ),
    "drifted_weights": (("drift",), f"SELECT date, ticker, {_r('weight')} FROM drift WHERE portfolio = 'equal_weight_signal'"),
    "constraint_checks": (
        ("book",),
        f"SELECT date, portfolio, count(*) AS n, {_r('sum(tw)', name='weight_sum')}, {_r('min(tw)', name='minimum_weight')}, {_r('max(tw) FILTER (tradable)', name='maximum_weight')}, {_r('max(abs(tw - bw)) FILTER (tradable)', name='maximum_active')}, {_r('sum(abs(tw - bw)) / 2', name='active_share')}, "
        f"{_r('sum(CASE WHEN cand THEN tw ELSE 0 END)', name='candidate_weight')}, count(*) FILTER (tw > 1e-6) AS holdings, {_r('0.15 - max(tw) FILTER (tradable)', name='weight_slack')}, {_r('0.12 - max(abs(tw - bw)) FILTER (tradable)', name='active_slack')}, "
        "abs(sum(tw) - 1) <= 1e-8 AND min(tw) >= -1e-6 AND max(tw) FILTER (tradable) <= 0.15 + 1e-6 AND max(abs(tw - bw)) FILTER (tradable) <= 0.12 + 1e-6 AS passed FROM book GROUP BY date, portfolio",
    ),
    "industry_exposures": (
        ("book",),
        f"SELECT date, portfolio, factor, {_r('p', name='portfolio_exposure')}, {_r('b', name='benchmark_exposure')}, {_r('p - b', name='active_exposure')}, {_r('p - b + 0.2', name='lower_slack')}, {_r('0.2 - (p - b)', name='upper_slack')}, p - b + 0.2 >= -1e-6 AND 0.2 - (p - b) >= -1e-6 AS passed FROM (SELECT date, portfolio, 'INDUSTRY:' || industry AS factor, sum(tw) AS p, sum(bw) AS b FROM book GROUP BY ALL)",
    ),
    "resolved_ranges": (("resolved",), f"SELECT date, factor, {_r('lower::DOUBLE', name='lower')}, {_r('upper::DOUBLE', name='upper')}, level FROM resolved"),
    "range_report": (
        ("resolved", "active"),
        f"SELECT date, portfolio, name AS \"constraint\", {_r('value')}, {_r('bound')}, {_r('excess')}, CASE WHEN excess > 1e-6 THEN 'violated' WHEN abs(excess) <= 1e-6 THEN 'binding' ELSE 'slack' END AS status FROM (SELECT h.date, portfolio, 'active_exposure_range:' || r.factor || ':' || unnest(['lower', 'upper']) AS name, coalesce(a, 0.0) AS value, "
        "unnest([lower, upper]::DOUBLE[]) AS bound, unnest([lower - coalesce(a, 0.0), coalesce(a, 0.0) - upper]::DOUBLE[]) AS excess FROM (SELECT DISTINCT date, portfolio FROM active) h JOIN resolved r USING (date) LEFT JOIN active x USING (date, portfolio, factor))",
    ),
    "covariance_diagnostics": (
        ("awin", "fr"),
        f"SELECT as_of AS matrix, 2 AS names, {_r('low', name='min_eigenvalue_before')}, {_r('high', name='max_eigenvalue_before')}, {_r('greatest(low, 0.036)', name='min_eigenvalue_after')}, {_r('sqrt(greatest(0.036 - low, 0) ** 2 + greatest(0.036 - high, 0) ** 2)', name='repair_frobenius')}, 0.0::DOUBLE AS max_asymmetry, low < 0.036 AS was_repaired FROM ("
        "SELECT as_of, (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b) AS low, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS high FROM (SELECT as_of, sum(v) FILTER (fa = 'MARKET' AND fb = 'MARKET') AS a, sum(v) FILTER (fa = 'SIZE' AND fb = 'SIZE') AS d, sum(v) FILTER (fa = 'MARKET' AND fb = 'SIZE') AS b FROM ("
        "SELECT as_of, a.factor AS fa, b.factor AS fb, (sum(w * a.f * b.f) / sum(w) - sum(w * a.f) * sum(w * b.f) / sum(w) ** 2) / (1 - sum(w * w) / sum(w) ** 2) * 12 * CASE WHEN a.factor = b.factor THEN 1.0 ELSE 0.9 END AS v FROM (SELECT *, 0.5 ** (age / 12.0) AS w FROM awin) JOIN fr a USING (date) JOIN fr b USING (date) GROUP BY as_of, a.factor, b.factor) GROUP BY as_of))",
    ),
    "risk_asof_diagnostics": (
        ("iwin", "ireg", "ifr", "atarget", "ispec", "iplaced"),
        f"SELECT * FROM (SELECT as_of, count(*) AS periods, min(date) AS first, max(date) AS last, min(n) AS names_min, {_r('median(n)', name='names_median')}, max(n) AS names_max FROM iwin JOIN (SELECT date, count(*) AS n FROM ireg GROUP BY date) USING (date) GROUP BY as_of) "
        f"JOIN (SELECT as_of, count(*) AS factors, {_r('sum(sqrt(v))', name='factor_volatility')} FROM (SELECT as_of, factor, (sum(w * f * f) / sum(w) - (sum(w * f) / sum(w)) ** 2) / (1 - sum(w * w) / sum(w) ** 2) * 12 AS v FROM (SELECT *, 0.5 ** (age / 12.0) AS w FROM iwin) JOIN ifr USING (date) GROUP BY as_of, factor) GROUP BY as_of) USING (as_of) "
        f"JOIN (SELECT as_of, count(*) AS targets, count(*) FILTER (own IS NULL) AS imputed, {_r('avg((own IS NULL)::INT)', name='imputed_share')}, {_r('min(d)', name='specific_min')}, {_r('median(d)', name='specific_median')}, {_r('max(d)', name='specific_max')} FROM (SELECT as_of, ticker, s.v AS own, greatest(coalesce(s.v, i.im, g.gm), 1e-6) AS d "
        "FROM atarget JOIN iplaced USING (as_of, ticker) LEFT JOIN ispec s USING (as_of, ticker) LEFT JOIN (SELECT as_of, code, median(v) AS im FROM ispec JOIN iplaced USING (as_of, ticker) GROUP BY as_of, code) i USING (as_of, code) LEFT JOIN (SELECT as_of, median(v) AS gm FROM ispec GROUP BY as_of) g USING (as_of)) GROUP BY as_of) USING (as_of)",
    ),
    "sweep_summary": (
        ("vdaily", "scored"),
        "SELECT variant, CASE WHEN variant = 'wide' THEN 'failed' ELSE 'success' END AS status, CASE WHEN variant = 'wide' THEN 'fewer than 1000000 candidates on ' || (SELECT count(DISTINCT date) FROM scored) || ' dates' END AS error, reused_from, observations, "
        + ", ".join(_r(x, 5, n) for x, n in (("nav", "ending_nav"), ("nav ** (12.0 / observations) - 1", "annualized_return"), ("turned", "total_turnover"), ("cost", "total_cost"), ("nav / bench_nav", "active_ending_nav"), ("low", "maximum_drawdown")))
        + " FROM (VALUES ('base', NULL, 'base'), ('small', NULL, 'small'), ('skewed', NULL, 'skewed'), ('costly', NULL, 'costly'), ('wide', NULL, 'wide'), ('again', 'base', 'base')) v(variant, reused_from, portfolio) "
        "LEFT JOIN (SELECT portfolio, count(*) AS observations, arg_max(nav, date) AS nav, sum(turnover) AS turned, sum(transaction_cost) AS cost, min(drawdown) AS low FROM vdaily GROUP BY portfolio) USING (portfolio), (SELECT arg_max(nav, date) AS bench_nav FROM vdaily WHERE portfolio = 'benchmark')",
    ),
    "rolling_checks": (("bench",), "SELECT date, portfolio, 5 AS n_limits, 0 AS n_violated FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS ix FROM (SELECT DISTINCT date FROM bench)), (SELECT unnest(['reversed', 'signal']) AS portfolio) WHERE ix % 3 = 0"),
    "constraint_report": (
        ("book",),
        f"SELECT date, portfolio, name AS \"constraint\", {_r('value')}, {_r('bound')}, {_r('excess')}, CASE WHEN excess > 1e-6 THEN 'violated' WHEN abs(excess) <= 1e-6 THEN 'binding' ELSE 'slack' END AS status FROM (SELECT *, CASE WHEN name IN ('long_only', 'candidate_weight_range:lower') THEN bound - value ELSE value - bound END AS excess FROM (SELECT date, portfolio, "
        "unnest(['fully_invested', 'long_only', 'max_weight', 'max_active_weight', 'tradability_freeze', 'max_turnover', 'candidate_weight_range:lower']) AS name, "
        "unnest([abs(sum(tw) - 1), min(tw), coalesce(max(tw) FILTER (tradable), 0), coalesce(max(abs(tw - bw)) FILTER (tradable), 0), max(abs(tw - bw)) FILTER (NOT tradable), sum(abs(tw - bw)) / 2, sum(CASE WHEN cand THEN tw ELSE 0 END)]) AS value, "
        "unnest([1e-8, 0.0, 0.15, 0.12, 0.0, 0.8, 0.5]) AS bound FROM book GROUP BY date, portfolio)) WHERE value IS NOT NULL",
    ),
    "single_date_problem": (
        ("universe", "panel", "bench", "candidates"),
        f"SELECT u.date, u.ticker, {_r('coalesce(s.score, 0)', name='score')}, {_r('coalesce(s.score, 0) * 0.05', name='expected_return')}, {_r('coalesce(b.benchmark_weight, 0)', name='benchmark_weight')}, CAST(NULL AS DOUBLE) AS current_weight, true AS tradable, c.ticker IS NOT NULL AS is_candidate, s.score IS NULL AS was_missing FROM universe u "
        f"LEFT JOIN (SELECT date, ticker, CASE WHEN stddev_pop(c) {_DAY} > 1e-12 THEN c / stddev_pop(c) {_DAY} END AS score FROM (SELECT date, ticker, rk / n - avg(rk / n) {_DAY} AS c FROM (SELECT date, ticker, rank() OVER (PARTITION BY date ORDER BY w) + (count(*) OVER (PARTITION BY date, w) - 1) / 2.0 AS rk, count(*) {_DAY} AS n "
        f"FROM (SELECT date, ticker, {_clip('prediction', 'med', 'mad', 5.0)} AS w FROM {_mad('(SELECT * FROM panel WHERE tradable)', 'prediction', 'date, ticker, prediction')})))) s ON s.date = u.date AND s.ticker = u.ticker LEFT JOIN bench b ON b.date = u.date AND b.ticker = u.ticker LEFT JOIN candidates c ON c.date = u.date AND c.ticker = u.ticker",
    ),
    "normalize_keys": ((), "SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y%m%d') AS date, CAST(l_suppkey AS VARCHAR) AS ticker, l_linestatus <> 'F' AS open_line FROM lineitem"),
}
FINALS["asset_covariance_blocks"] = FINALS["asset_covariance"]
_LOCAL = {
    "frozen_signal_gate": (
        "chosen AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS ix FROM (SELECT DISTINCT date FROM panel WHERE date BETWEEN '19960101' AND '20011231')) WHERE ix % 3 = 0), "
        "full_signal AS (SELECT p.* FROM panel p JOIN chosen USING (date)), able AS (SELECT * FROM full_signal WHERE cap >= 100000), "
        "best AS (SELECT date, ticker FROM (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY prediction DESC, ticker) AS place FROM able WHERE tradable) WHERE place <= 5), "
        "raw AS (SELECT date, ticker, benchmark_weight * 1.0002 AS w FROM bench JOIN chosen USING (date)), pos AS (SELECT raw.*, able.ticker IS NOT NULL AS known FROM raw LEFT JOIN able USING (date, ticker) WHERE w > 1e-8), "
        "per AS (SELECT date, (SELECT count(*) FROM best b WHERE b.date = c.date) AS n_best, (SELECT sum(w) FROM raw r WHERE r.date = c.date) AS total, (SELECT coalesce(sum(w), 0) FROM pos r WHERE r.date = c.date AND NOT known) AS lost, "
        "(SELECT count(*) FROM (SELECT ticker FROM best b WHERE b.date = c.date UNION SELECT ticker FROM pos q WHERE q.date = c.date AND known)) AS n_all FROM chosen c)"
    ),
    "terminal_returns": "rr AS (SELECT * FROM rets WHERE date <= '20030101' OR ticker NOT LIKE '%3')",
    "specific_impute": "k AS (SELECT * FROM spec WHERE ticker NOT LIKE '%7')",
}


def _needed(names: tuple[str, ...], done: list[str]) -> list[str]:
    for name in names:
        if name not in done:
            _needed(CTES[name][0], done)
            done.append(name)
    return done


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (needs, select) in FINALS.items():
        parts = [f"{c} AS MATERIALIZED ({CTES[c][1]})" for c in _needed(needs, [])]
        if name in _LOCAL:
            parts.append(_LOCAL[name])
        out[name] = (f"WITH {', '.join(parts)} " if parts else "") + select
    return out
