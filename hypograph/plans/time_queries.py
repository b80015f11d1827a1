"""Queries on mention series and corpus windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions.measures import DAY
from ..operators import timeline as tl
from ..operators.sizing import scratch_dir, written
from . import fixtures as fx
from . import jobs
from .fixtures import SERIES_KEYS, with_cte


def freq_second_derivative(spark, d):
    out = tl.frequency_derivative(fx.series(spark, d), SERIES_KEYS)
    return out.select(*SERIES_KEYS, "id", "seq", F.coalesce("freq_sec_deriv", F.lit(-9999.0)).alias("freq_sec_deriv"))


def mention_gaps(spark, d):
    out = tl.mention_gaps(fx.series(spark, d), SERIES_KEYS)
    return out.select(*SERIES_KEYS, "id", "seq", "gap")


def gap_histogram(spark, d):
    gaps = tl.gap_counts(fx.series(spark, d), SERIES_KEYS)
    return tl.equal_width_histogram(gaps, SERIES_KEYS, "gap")


def mention_series(spark, d):
    out = tl.mention_series(fx.series(spark, d), SERIES_KEYS)
    return out.select(*SERIES_KEYS, "seq", "id", "ts")


def long_mention_series(spark, d):
    """Dated mentions of the users with a long series."""
    dated = fx.series(spark, d).filter("ts is not null")
    return tl.long_series(dated, ["user_id"], min_size=50).select("user_id", "id", "ts")


def mention_series_store(spark, d):
    """Long series built once and then read from the store."""
    series, store = fx.series(spark, d), scratch_dir(spark, "series")
    jobs.stored_series(spark, store, series, ["user_id"], min_size=50, ts="ts")
    return jobs.stored_series(spark, store, series, ["user_id"], min_size=50, ts="ts").select("user_id", "seq", "id", "ts")


def series_store_inputs(spark, d):
    """One store asked for the series of two inputs: each gets its own, the second time from the store."""
    series, store = fx.series(spark, d), scratch_dir(spark, "series")
    out = None
    for name, rows in (("even", series.filter("user_id % 2 = 0")), ("all", series), ("even again", series.filter("user_id % 2 = 0"))):
        stored = jobs.stored_series(spark, store, rows, ["user_id"], min_size=50, ts="ts")
        part = stored.groupBy("user_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("input"), "user_id", "n")
        out = part if out is None else out.unionByName(part)
    return out


def gap_quantiles(spark, d):
    """Quartiles of the seconds between neighbouring mentions, per kind of event and over all users."""
    gaps = written(tl.mention_gaps(fx.series(spark, d), SERIES_KEYS).select("event_type", "gap"), "gaps")
    out = tl.exact_quantiles(gaps, ["event_type"], [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0], "gap")
    return out.select("event_type", "cut", F.round("quantile", 4).alias("quantile"))


def date_quantiles(spark, d):
    """Quantiles of the time stamps themselves: nearly all values differ."""
    rows = written(fx.table(spark, d, "events").select("event_type", (F.col("event_id") * 1_000_003 % 998_244_353).alias("x")), "stamps")
    out = tl.exact_quantiles(rows, ["event_type"], [0.01, 0.5, 0.99], "x")
    return out.select("event_type", "cut", F.round("quantile", 4).alias("quantile"))


def mention_histogram(spark, d):
    return tl.time_histogram(fx.series(spark, d), SERIES_KEYS, width=3 * DAY)


def decile_histogram(spark, d):
    counts = tl.date_counts(fx.series(spark, d), SERIES_KEYS)
    return tl.equal_width_histogram(counts, SERIES_KEYS, "ts")


def neighbour_window(spark, d):
    out = tl.neighbour_windows(fx.series(spark, d), SERIES_KEYS, "id", n=3)
    return out.select(*SERIES_KEYS, "last_seq", F.concat_ws(",", F.col("window").cast("array<string>")).alias("ids"))


def profile_filter(spark, d):
    profiles = tl.key_profiles(fx.series(spark, d), SERIES_KEYS)
    special = F.col("user_id") % 10 == 0
    return tl.profiled(profiles, special, true_min=14, false_min=16, special_min=10, plot_min=15)


def unprofiled_pairs(spark, d):
    profiles = tl.key_profiles(fx.series(spark, d), SERIES_KEYS)
    special = F.col("user_id") % 10 == 0
    shown = tl.profiled(profiles, special, true_min=14, false_min=16, special_min=10, plot_min=15).filter("kind = 'true'")
    return tl.remaining(profiles.select(*SERIES_KEYS), shown.select(*SERIES_KEYS))


def _months(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "n_chars")
    return tl.monthly(docs.select(fx.pub_date().alias("pub_date")))


def monthly_corpus(spark, d):
    docs = fx.table(spark, d, "documents").select("n_chars", fx.pub_date().alias("pub_date"))
    return tl.monthly(docs, measure=F.col("n_chars")).select(F.date_format("month", "yyyy-MM").alias("month"), "n")


def months_sorted(spark, d):
    return _months(spark, d).orderBy("month").select(F.date_format("month", "yyyy-MM").alias("month"), "n")


def trailing_window(spark, d):
    out = tl.trailing_windows(_months(spark, d))
    return out.select("window", F.date_format("window_end", "yyyy-MM").alias("until"), "n")


def trailing_members(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "n_chars", fx.pub_date().alias("pub_date"))
    out = tl.window_members(docs, 2)
    return out.groupBy(F.date_format("window_end", "yyyy-MM").alias("until")).agg(F.sum("n_chars").alias("n_chars"))


def window_vocabulary(spark, d):
    """Distinct words of every trailing window and up to every month."""
    words = fx.table(spark, d, "documents").select(F.explode(F.array_distinct(F.split("text", " "))).alias("word"), fx.pub_date().alias("pub_date"))
    out = tl.window_distinct(words, "word")
    return out.select("window", F.date_format("window_end", "yyyy-MM").alias("until"), "n_terms")


def cumulative_window(spark, d):
    out = tl.cumulative_windows(_months(spark, d), min_size=100)
    return out.select(F.date_format("month", "yyyy-MM").alias("until"), "n_until")


def window_grid(spark, d):
    return tl.model_grid(_months(spark, d))


def param_todo(spark, d):
    """Grid rows whose model does not exist yet: those of every even year are done."""
    grid = tl.model_grid(_months(spark, d))
    done = grid.filter(F.substring("until", 1, 4).cast("int") % 2 == 0)
    return tl.remaining(grid, done)


def date_parse(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("day"))
    k = F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, F.date_format("day", "d-M-yyyy"))
        .when(k == 1, F.date_format("day", "dd-MM-yyyy"))
        .when(k == 2, F.date_format("day", "d-MMM-yyyy"))
        .when(k == 3, F.concat(F.lit("-"), F.date_format("day", "-M-yyyy")))
        .otherwise(F.date_format("day", "yyyy"))
    )
    t = o.withColumn("text", text)
    parsed = dt.parse_date(F.col("text"))
    none = F.lit(-1)
    return t.select(
        "o_orderkey",
        "text",
        F.coalesce(dt.epoch_seconds(parsed), none).alias("ts"),
        F.coalesce(dt.year_of(F.col("text")), none).alias("year"),
        F.coalesce(dt.month_of(F.col("text")), none).alias("month"),
        F.coalesce(dt.month_year(F.col("text")), F.lit("")).alias("month_year"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        freq_second_derivative,
        mention_gaps,
        gap_histogram,
        mention_series,
        long_mention_series,
        mention_series_store,
        series_store_inputs,
        gap_quantiles,
        date_quantiles,
        mention_histogram,
        decile_histogram,
        neighbour_window,
        profile_filter,
        unprofiled_pairs,
        monthly_corpus,
        months_sorted,
        trailing_window,
        trailing_members,
        window_vocabulary,
        cumulative_window,
        window_grid,
        param_todo,
        date_parse,
    )
}

_PROFILE = """SELECT user_id, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, bool_or(fact) AS any_fact
FROM series GROUP BY user_id, event_type"""
_KIND = """SELECT *, CASE WHEN any_fact AND (n > 14 OR user_id % 10 = 0) THEN 'true'
WHEN n > 16 OR (user_id % 10 = 0 AND n > 10) THEN 'false' END AS kind FROM profiles"""
_SHOWN = "kind IS NOT NULL AND (n >= 15 OR user_id % 10 = 0) AND n > 1"
_BIN = "CASE WHEN hi = lo THEN 5 ELSE least(((x - lo) * 10) // (hi - lo), 9) END"
_DOC_MONTHS = "SELECT date_trunc('month', pub_date) AS month, count(*) AS n FROM articles GROUP BY 1"
_GRID = """SELECT w AS "window", strftime(month, '%Y-%m') AS until, m AS mode FROM months,
(VALUES ('month'), ('2month'), ('year'), ('2year'), ('3year')) a(w), (VALUES ('word'), ('bigram')) b(m)
UNION SELECT 'cumulative', strftime(month, '%Y'), m FROM months, (VALUES ('word'), ('bigram')) b(m)"""
_DEPTHS = "(VALUES ('month', 1), ('2month', 2), ('year', 12), ('2year', 24), ('3year', 36)) w(window_name, depth)"

ORACLE = {
    "freq_second_derivative": with_cte(
        "numbered",
        """, prefix AS (SELECT m.user_id, m.event_type, m.id, p.ts AS x, min(p.ts) OVER (PARTITION BY m.id) AS lo, max(p.ts) OVER (PARTITION BY m.id) AS hi
          FROM numbered m JOIN numbered p ON p.user_id = m.user_id AND p.event_type = m.event_type AND p.seq < m.seq WHERE m.seq >= 3),
        h AS (SELECT id, CASE WHEN hi = lo THEN 5 ELSE least(((x - lo) * 10) // (hi - lo), 9) END AS bin FROM prefix),
        s AS (SELECT id, CAST(sum(CASE bin WHEN 0 THEN 1.25 WHEN 1 THEN -1.5 WHEN 2 THEN 0.25 WHEN 7 THEN 0.25 WHEN 8 THEN -1.5 WHEN 9 THEN 1.25 ELSE 0 END) AS DOUBLE) AS v FROM h GROUP BY id)
        SELECT user_id, event_type, id, seq, coalesce(v, -9999.0::DOUBLE) AS freq_sec_deriv FROM numbered LEFT JOIN s USING (id)""",
    ),
    "mention_gaps": with_cte(
        "numbered",
        """SELECT user_id, event_type, id, seq, abs(coalesce(lead(ts) OVER w, first_value(ts) OVER w) - ts) AS gap FROM numbered
        WINDOW w AS (PARTITION BY user_id, event_type ORDER BY seq)""",
    ),
    "gap_histogram": with_cte(
        "numbered",
        f""", g AS (SELECT user_id, event_type, abs(coalesce(lead(ts) OVER w, first_value(ts) OVER w) - ts) AS x FROM numbered
        WINDOW w AS (PARTITION BY user_id, event_type ORDER BY seq)),
        r AS (SELECT *, min(x) OVER (PARTITION BY user_id, event_type) AS lo, max(x) OVER (PARTITION BY user_id, event_type) AS hi FROM g)
        SELECT user_id, event_type, {_BIN} AS bin, count(*) AS n FROM r GROUP BY ALL""",
    ),
    "mention_series": with_cte("numbered", "SELECT user_id, event_type, seq, id, ts FROM numbered"),
    "long_mention_series": with_cte(
        "series",
        """SELECT user_id, id, ts FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM series WHERE ts IS NOT NULL) WHERE n >= 50""",
    ),
    "series_store_inputs": with_cte(
        "series",
        """, sizes AS (SELECT user_id, count(*) AS n FROM series WHERE ts IS NOT NULL GROUP BY 1 HAVING count(*) >= 50)
        SELECT 'all' AS input, user_id, n FROM sizes UNION ALL
        SELECT unnest(['even', 'even again']), user_id, n FROM sizes WHERE user_id % 2 = 0""",
    ),
    "gap_quantiles": with_cte(
        "series",
        """, gaps AS (SELECT event_type, abs(coalesce(lead(ts) OVER w, first(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts)) - ts) AS gap
          FROM series WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, id))
        SELECT event_type, cut, round(CASE cut WHEN 0 THEN quantile_cont(gap, 0) WHEN 0.1 THEN quantile_cont(gap, 0.1) WHEN 0.25 THEN quantile_cont(gap, 0.25)
          WHEN 0.5 THEN quantile_cont(gap, 0.5) WHEN 0.75 THEN quantile_cont(gap, 0.75) WHEN 0.9 THEN quantile_cont(gap, 0.9) ELSE quantile_cont(gap, 1) END, 4) AS quantile
        FROM gaps, (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0])::DOUBLE AS cut) GROUP BY event_type, cut""",
    ),
    "date_quantiles": """SELECT event_type, cut, round(CASE cut WHEN 0.01 THEN quantile_cont(x, 0.01) WHEN 0.5 THEN quantile_cont(x, 0.5) ELSE quantile_cont(x, 0.99) END, 4) AS quantile
        FROM (SELECT event_type, event_id * 1000003 % 998244353 AS x FROM events), (SELECT unnest([0.01, 0.5, 0.99])::DOUBLE AS cut) GROUP BY event_type, cut""",
    "mention_series_store": with_cte(
        "series",
        """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) - 1 AS seq, id, ts
        FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM series WHERE ts IS NOT NULL) WHERE n >= 50""",
    ),
    "mention_histogram": with_cte(
        "series",
        """, b AS (SELECT user_id, event_type, (ts - min(ts) OVER (PARTITION BY user_id, event_type)) // 259200 AS bin FROM series WHERE ts IS NOT NULL),
        span AS (SELECT user_id, event_type, unnest(range(0, max(bin) + 1)) AS bin FROM b GROUP BY user_id, event_type)
        SELECT user_id, event_type, bin, count(b.bin) AS n FROM span LEFT JOIN b USING (user_id, event_type, bin) GROUP BY ALL""",
    ),
    "decile_histogram": with_cte(
        "series",
        f""", r AS (SELECT user_id, event_type, ts AS x, min(ts) OVER (PARTITION BY user_id, event_type) AS lo,
        max(ts) OVER (PARTITION BY user_id, event_type) AS hi FROM series WHERE ts IS NOT NULL)
        SELECT user_id, event_type, {_BIN} AS bin, count(*) AS n FROM r GROUP BY ALL""",
    ),
    "neighbour_window": with_cte(
        "numbered",
        """SELECT user_id, event_type, seq AS last_seq, ids FROM (SELECT *, lag(id, 2) OVER w || ',' || lag(id, 1) OVER w || ',' || id AS ids FROM numbered
        WINDOW w AS (PARTITION BY user_id, event_type ORDER BY seq)) WHERE seq >= 2""",
    ),
    "profile_filter": with_cte("series", f", profiles AS ({_PROFILE}), k AS ({_KIND}) SELECT * FROM k WHERE {_SHOWN}"),
    "unprofiled_pairs": with_cte(
        "series",
        f""", profiles AS ({_PROFILE}), k AS ({_KIND}) SELECT user_id, event_type FROM profiles p
        WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = p.user_id AND k.event_type = p.event_type AND kind = 'true' AND {_SHOWN})""",
    ),
    "monthly_corpus": """SELECT strftime(DATE '2010-01-01' + CAST(doc_id % 3650 AS INTEGER), '%Y-%m') AS month, CAST(sum(n_chars) AS BIGINT) AS n
        FROM documents GROUP BY 1""",
    "months_sorted": with_cte("articles", "SELECT strftime(pub_date, '%Y-%m') AS month, count(*) AS n FROM articles GROUP BY 1 ORDER BY 1"),
    "trailing_window": with_cte(
        "articles",
        f""", months AS ({_DOC_MONTHS}), ends AS (SELECT unnest(generate_series((SELECT min(month) FROM months), (SELECT max(month) FROM months), INTERVAL 1 MONTH)) AS e)
        SELECT window_name AS "window", strftime(e, '%Y-%m') AS until, CAST(sum(n) AS BIGINT) AS n FROM ends, {_DEPTHS}, months
        WHERE month <= e AND month > e - to_months(depth) GROUP BY ALL""",
    ),
    "window_vocabulary": with_cte(
        "articles",
        f""", tm AS (SELECT DISTINCT date_trunc('month', DATE '2010-01-01' + CAST(doc_id % 3650 AS INTEGER)) AS m, unnest(string_split(text, ' ')) AS t FROM documents),
        ends AS (SELECT unnest(generate_series((SELECT min(m) FROM tm), (SELECT max(m) FROM tm), INTERVAL 1 MONTH)) AS e)
        SELECT window_name AS "window", strftime(e, '%Y-%m') AS until, count(DISTINCT t) AS n_terms FROM ends, {_DEPTHS}, tm WHERE m <= e AND m > e - to_months(depth) GROUP BY ALL
        UNION ALL SELECT 'cumulative', strftime(e, '%Y-%m'), count(DISTINCT t) FROM ends, tm WHERE m <= e GROUP BY ALL""",
    ),
    "trailing_members": """SELECT strftime(e, '%Y-%m') AS until, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM (
        SELECT n_chars, unnest([m, m + INTERVAL 1 MONTH]) AS e FROM (SELECT n_chars, date_trunc('month', DATE '2010-01-01' + CAST(doc_id % 3650 AS INTEGER)) AS m FROM documents))
        GROUP BY 1""",
    "cumulative_window": with_cte(
        "articles",
        f""", months AS ({_DOC_MONTHS}) SELECT strftime(month, '%Y-%m') AS until, CAST(s AS BIGINT) AS n_until
        FROM (SELECT month, sum(n) OVER (ORDER BY month) AS s FROM months) WHERE s >= 100""",
    ),
    "window_grid": with_cte("articles", f", months AS ({_DOC_MONTHS}) {_GRID}"),
    "param_todo": with_cte(
        "articles",
        f", months AS ({_DOC_MONTHS}) SELECT * FROM ({_GRID}) WHERE CAST(substr(until, 1, 4) AS INTEGER) % 2 = 1",
    ),
    "date_parse": """SELECT o_orderkey, text, CASE WHEN k < 3 THEN CAST(epoch(day) AS BIGINT) ELSE -1 END AS ts,
        CASE WHEN k < 3 THEN year(day) ELSE -1 END AS year, CASE WHEN k < 2 THEN month(day) ELSE -1 END AS month,
        CASE WHEN k < 2 THEN month(day) || '-' || year(day) ELSE '' END AS month_year FROM (
        SELECT o_orderkey, o_orderkey % 5 AS k, CAST(o_orderdate AS DATE) AS day,
        CASE o_orderkey % 5 WHEN 0 THEN day(o_orderdate) || '-' || month(o_orderdate) || '-' || year(o_orderdate)
        WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 2 THEN day(o_orderdate) || strftime(o_orderdate, '-%b-%Y')
        WHEN 3 THEN '--' || month(o_orderdate) || '-' || year(o_orderdate) ELSE CAST(year(o_orderdate) AS VARCHAR) END AS text FROM orders)""",
}
