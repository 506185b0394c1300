"""Registry of the queries and the shared parts of their SQL.

Each query is a Spark function over the driver's tables plus, where SQL can say it,
the SQL that must give the same rows. The SQL is written from the definitions, with
plain windows and recursion rather than the library's block and bucket methods.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6

HOUR = 3_600_000_000
DAY = 24 * HOUR
DUR = 15 * DAY


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and doubles rounded, so both engines agree."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


# Shared table expressions; a name used in the SQL brings what it needs.
CTES: dict[str, str] = {
    "ev": """SELECT user_id // 60 AS rec, user_id % 60 + 1 AS pin,
        CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'baseline' ELSE 'treatment' END AS condition,
        epoch_us(ts) - epoch_us(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN TIMESTAMP '2024-01-16'
            - INTERVAL 15 DAY ELSE TIMESTAMP '2024-01-16' END) AS t_us FROM events""",
    "spikes": """SELECT 'events-' || condition || '_#' || (rec + 1) AS recording_id, rec + 1 AS pair_no, condition,
        CASE WHEN rec % 3 = 2 THEN 'ket' ELSE 'doi' END AS study, pin + (pin - 1) // 15 AS channel, t_us FROM ev""",
    "chans": """SELECT DISTINCT 'events-' || c.condition || '_#' || (rec + 1) AS recording_id, rec + 1 AS pair_no,
        c.condition, CASE WHEN rec % 3 = 2 THEN 'ket' ELSE 'doi' END AS study, pin + (pin - 1) // 15 AS channel
        FROM ev CROSS JOIN (VALUES ('baseline'), ('treatment')) c(condition)""",
    "recs": "SELECT DISTINCT recording_id, study, condition, pair_no FROM chans",
    "labels60": "SELECT unnest(range(1, 61)) AS pin, unnest([47,48,46,45,38,37,28,36,27,17,26,16,35,25,15,14,24,34,13,23,"
        "12,22,33,21,32,31,44,43,41,42,52,51,53,54,61,62,71,63,72,82,73,83,64,74,84,85,75,65,86,76,87,77,66,78,67,"
        "68,55,56,58,57]) AS label",
    "elec": """SELECT pin + (pin - 1) // 15 AS channel, pin, label, label % 10 AS grid_row, label // 10 AS grid_col,
        label // 10 AS x, 9 - label % 10 AS y FROM labels60""",
    "epairs": """SELECT a.channel AS i, b.channel AS j, a.label AS label_i, b.label AS label_j,
        sqrt((a.x - b.x)::DOUBLE ** 2 + (a.y - b.y)::DOUBLE ** 2) AS dist FROM elec a JOIN elec b ON a.channel < b.channel""",
    "seq": """SELECT *, row_number() OVER w AS idx, lag(t_us) OVER w AS prev, lead(t_us) OVER w AS next
        FROM spikes WINDOW w AS (PARTITION BY recording_id, channel ORDER BY t_us)""",
    "isl": f"""SELECT *, sum(CASE WHEN t_us - prev <= {8 * HOUR} THEN 0 ELSE 1 END)
        OVER (PARTITION BY recording_id, channel ORDER BY idx) AS island FROM seq""",
    "bursts": f"""SELECT recording_id, channel, min(idx) FILTER (WHERE next - t_us <= {4 * HOUR}) AS start_idx,
        max(idx) AS end_idx, min(t_us) FILTER (WHERE next - t_us <= {4 * HOUR}) AS start_us, max(t_us) AS end_us
        FROM isl GROUP BY recording_id, channel, island
        HAVING max(idx) - min(idx) FILTER (WHERE next - t_us <= {4 * HOUR}) + 1 >= 3""",
    "summary": f"""SELECT c.*, coalesce(s.n, 0)::BIGINT AS n_spikes, coalesce(s.n, 0) * {float(DAY)} / {DUR} AS spike_rate,
        coalesce(b.n, 0)::BIGINT AS n_bursts, coalesce(b.n, 0) * {float(DAY)} / {DUR} AS burst_rate
        FROM chans c LEFT JOIN (SELECT recording_id, channel, count(*) AS n FROM spikes GROUP BY ALL) s USING (recording_id, channel)
        LEFT JOIN (SELECT recording_id, channel, count(*) AS n FROM bursts GROUP BY ALL) b USING (recording_id, channel)""",
    "obs2": """SELECT b.study, b.pair_no, b.channel, b.spike_rate AS sb, t.spike_rate AS st, b.burst_rate AS bb,
        t.burst_rate AS bt, b.n_spikes::DOUBLE AS nsb, t.n_spikes::DOUBLE AS nst, b.n_bursts::DOUBLE AS nbb,
        t.n_bursts::DOUBLE AS nbt FROM summary b JOIN summary t USING (study, pair_no, channel)
        WHERE b.condition = 'baseline' AND t.condition = 'treatment'""",
    "obs": """SELECT study, pair_no, channel, 'spike_rate' AS metric, sb AS b, st AS t FROM obs2
        UNION ALL SELECT study, pair_no, channel, 'burst_rate', bb, bt FROM obs2""",
    "pooled": "SELECT study, metric, b AS y FROM obs UNION ALL SELECT study, metric, t FROM obs",
    "spct": """SELECT study, pair_no, channel, metric, b, t, CASE WHEN b = 0 THEN 1000.0::DOUBLE ELSE 100 * (t - b) / b END AS pct
        FROM obs WHERE metric = 'spike_rate' AND NOT (b = 0 AND t = 0)""",
    "bpct": """SELECT study, pair_no, channel, 'burst_rate' AS metric, bb AS b, bt AS t, 100 * (bt - bb) / bb AS pct FROM obs2
        WHERE NOT (bb = 0 AND bt = 0) AND NOT (sb = 0 AND st = 0) AND bb > 0 AND 100 * (bt - bb) / bb <= 1000""",
    "pct": "SELECT * FROM spct WHERE pct <= 1000 UNION ALL SELECT * FROM bpct",
    "bins": f"""SELECT recording_id, channel, bin, count(*) AS c FROM (SELECT recording_id, channel,
        CASE WHEN t_us = {DUR} THEN {DUR // HOUR - 1} ELSE t_us // {HOUR} END AS bin FROM spikes WHERE t_us <= {DUR}) GROUP BY ALL""",
    "moments": f"""SELECT recording_id, channel, s, s2, s / {DUR // HOUR} AS mu,
        CASE WHEN s2 * {DUR // HOUR} > s * s THEN sqrt((s2 - s * s / {DUR // HOUR}) / {DUR // HOUR - 1}) ELSE 1.0 END AS sd
        FROM (SELECT recording_id, channel, coalesce(sum(c), 0)::BIGINT AS s, coalesce(sum(c * c), 0)::BIGINT AS s2
        FROM chans LEFT JOIN bins USING (recording_id, channel) GROUP BY ALL)""",
    "lags": "SELECT unnest(range(-24, 25)) AS lag",
    "ends": f"""SELECT recording_id, channel, k, coalesce(sum(c) FILTER (WHERE bin < k), 0) AS head,
        coalesce(sum(c) FILTER (WHERE bin >= {DUR // HOUR} - k), 0) AS tail
        FROM chans LEFT JOIN bins USING (recording_id, channel) CROSS JOIN (SELECT unnest(range(0, 25)) AS k) GROUP BY ALL""",
    "cpairs": """SELECT a.recording_id, a.study, a.pair_no, a.condition, a.channel AS i, b.channel AS j FROM chans a JOIN chans b
        ON a.recording_id = b.recording_id AND a.channel < b.channel""",
    "coin": """SELECT a.recording_id, a.channel AS i, b.channel AS j, b.bin - a.bin AS lag, sum(a.c * b.c) AS c
        FROM bins a JOIN bins b ON a.recording_id = b.recording_id AND a.channel < b.channel
        AND b.bin BETWEEN a.bin - 24 AND a.bin + 24 GROUP BY ALL""",
    "cells": f"""SELECT p.*, lag, coalesce(c.c, 0) AS c, mi.s2 AS s2i, mj.s2 AS s2j, mi.mu AS mui, mj.mu AS muj,
        mi.sd AS sdi, mj.sd AS sdj, ({DUR // HOUR} - abs(lag))::DOUBLE AS over_n,
        mi.s - CASE WHEN lag >= 0 THEN ei.tail ELSE ei.head END AS sxi,
        mj.s - CASE WHEN lag >= 0 THEN ej.head ELSE ej.tail END AS sxj
        FROM cpairs p CROSS JOIN lags LEFT JOIN coin c USING (recording_id, i, j, lag)
        JOIN moments mi ON mi.recording_id = p.recording_id AND mi.channel = p.i
        JOIN moments mj ON mj.recording_id = p.recording_id AND mj.channel = p.j
        JOIN ends ei ON ei.recording_id = p.recording_id AND ei.channel = p.i AND ei.k = abs(lag)
        JOIN ends ej ON ej.recording_id = p.recording_id AND ej.channel = p.j AND ej.k = abs(lag)""",
    "scores": """SELECT recording_id, study, pair_no, condition, i, j, lag,
        round((c - muj * sxi - mui * sxj + over_n * mui * muj) / (sdi * sdj * over_n), 12) AS r FROM cells""",
    "edges": f"""SELECT recording_id, study, pair_no, condition, i, j, r AS w, lag * {HOUR} AS peak_lag_us FROM scores
        QUALIFY row_number() OVER (PARTITION BY recording_id, i, j ORDER BY r DESC, lag) = 1""",
    "thr": "SELECT recording_id, {pm:w:90} AS thr FROM (SELECT recording_id, list_sort(list(w)) AS w FROM edges GROUP BY ALL)",
    "gedges": "SELECT recording_id, i AS src, j AS dst FROM edges JOIN thr USING (recording_id) WHERE w > thr",
    "gboth": "SELECT * FROM gedges UNION ALL SELECT recording_id, dst, src FROM gedges",
    "gnodes": "SELECT recording_id, channel AS node FROM chans",
    "gdeg": """SELECT n.recording_id, n.node, count(b.dst) AS degree FROM gnodes n LEFT JOIN gboth b
        ON b.recording_id = n.recording_id AND b.src = n.node GROUP BY ALL""",
    "bfs": """SELECT recording_id, source, node, min(d) AS d FROM walk WHERE source <> node GROUP BY ALL""",
    "walk": """SELECT recording_id, src AS source, dst AS node, 1 AS d FROM gboth UNION
        SELECT w.recording_id, w.source, b.dst, w.d + 1 FROM walk w JOIN gboth b
        ON b.recording_id = w.recording_id AND b.src = w.node WHERE w.d < 59""",
    "comp": """SELECT n.recording_id, n.node, least(n.node, min(b.node)) AS component FROM gnodes n LEFT JOIN bfs b
        ON b.recording_id = n.recording_id AND b.source = n.node GROUP BY n.recording_id, n.node""",
    "smp": "SELECT label + 1 AS channel, vec_id * 64 + p - 1 AS n, embedding[p]::DOUBLE AS x FROM embeddings, "
        "(SELECT unnest(range(1, 65)) AS p)",
}


def pm(values: str, p: float) -> str:
    """SQL of the (k - 1/2)/n percentile over a sorted list."""
    n = f"len({values})"
    pos = f"({float(p)!r}::DOUBLE * {n} / 100 + 0.5)"
    lo, hi = f"least(greatest(floor({pos}), 1), {n})::BIGINT", f"least(greatest(ceil({pos}), 1), {n})::BIGINT"
    frac = f"(least(greatest({pos}, 1), {n}) - {lo})"
    return f"({values}[{lo}] + ({values}[{hi}] - {values}[{lo}]) * {frac})"


def _expand(text: str) -> str:
    return re.sub(r"\{pm:([\w.]+):([\d.]+)\}", lambda m: pm(m[1], float(m[2])), text)


def with_ctes(body: str, extra: str = "", recursive: bool = False) -> str:
    """Prefix ``body`` with ``extra`` and the shared expressions they name, in order."""
    order: list[str] = []

    def visit(text: str, inside: tuple[str, ...]) -> None:
        for name in CTES:
            if name not in inside and name not in order and re.search(rf"\b{name}\b", text):
                visit(CTES[name], (*inside, name))
                order.append(name)

    visit(extra + " " + body, ())
    parts = [f"{n} AS ({_expand(CTES[n])})" for n in order] + ([_expand(extra)] if extra else [])
    if not parts:
        return _expand(body)
    return f"WITH {'RECURSIVE ' if recursive or 'walk' in order else ''}{', '.join(parts)} {_expand(body)}"


def query(name: str, sql: str | None = None, dbl: str = "", ints: str = "", extra: str = "",
          recursive: bool = False):
    """Register a query; ``dbl``/``ints`` name the SQL columns to round or cast."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql is not None:
            swaps = [f"round({c}::DOUBLE, {DIGITS}) + 0.0 AS {c}" for c in dbl.split()]
            swaps += [f"{c}::BIGINT AS {c}" for c in ints.split()]
            inner = with_ctes(sql, extra, recursive)
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({inner}) q" if swaps else inner
        return fn

    return add
