"""Mention series over time.

A series is all dated mentions of a key, in order of date and id. Dates are whole days, so a series is first
counted per (key, date): that table is as long as the calendar however often a key is mentioned, and all ordered
windows run on it. Single mentions meet it again in one join on (key, date, part), where the parts are ranges of
(key, date, id): a key with a third of all mentions is split, even on one date, and the order is the same
whatever the number of parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import PROFILE_BIN_SECONDS, equal_width_bin
from .sizing import fits_broadcast, small_side, written

# Fixed values: (tenth, weight) of the cumulative counts in the sum of the twice applied gradient of a
# 10-bin histogram; the total has weight 1.25.
CURVATURE = [(1, 2.75), (2, -1.75), (3, 0.25), (7, -0.25), (8, 1.75), (9, -2.75)]
TOTAL_WEIGHT = 1.25
WINDOW_MONTHS = {"month": 1, "2month": 2, "year": 12, "2year": 24, "3year": 36}


def date_counts(series: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Mentions per key and date."""
    return series.filter(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(F.count("*").alias("n"))


def _parted(series: DataFrame, keys: list[str], ts: str, id_col: str, parts: int | None) -> DataFrame:
    """Dated mentions with ``part``, the number of their range in the order (key, date, id).

    Written, so that every use sees the same ranges.
    """
    dated = series.filter(F.col(ts).isNotNull())
    order = [*keys, ts, id_col]
    ranged = dated.repartitionByRange(parts, *order) if parts else dated.repartitionByRange(*order)
    return written(ranged.withColumn("part", F.spark_partition_id()), "series")


def _part_counts(parted: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return parted.groupBy(*keys, ts, "part").agg(F.count("*").alias("n"))


def _offsets(per: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Per (key, date, part): mentions of the key before the group, and before the date."""
    w = Window.partitionBy(*keys).orderBy(ts, "part").rowsBetween(Window.unboundedPreceding, -1)
    d = Window.partitionBy(*keys).orderBy(ts).rangeBetween(Window.unboundedPreceding, -1)
    return per.select(
        *keys,
        ts,
        "part",
        F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"),
        F.coalesce(F.sum("n").over(d), F.lit(0)).alias("before_date"),
    )


def _numbered(parted: DataFrame, table: DataFrame, keys: list[str], ts: str, id_col: str) -> DataFrame:
    """Mentions with ``seq``, their zero-based number in the key's series."""
    w = Window.partitionBy(*keys, ts, "part").orderBy(id_col)
    return parted.join(table, [*keys, ts, "part"]).withColumn("seq", F.col("before") + F.row_number().over(w) - 1)


def mention_series(
    series: DataFrame, keys: list[str], ts: str = "ts", id_col: str = "id", parts: int | None = None
) -> DataFrame:
    """The sorted series of every key as rows (keys, seq, ts, id)."""
    parted = _parted(series, keys, ts, id_col, parts)
    table = _offsets(_part_counts(parted, keys, ts), keys, ts)
    return _numbered(parted, table, keys, ts, id_col).drop("part", "before", "before_date")


def long_series(series: DataFrame, keys: list[str], min_size: int = 400) -> DataFrame:
    """Rows of series with at least ``min_size`` mentions."""
    big = series.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_size).select(*keys)
    return series.join(big, keys, "left_semi")


def mention_gaps(
    series: DataFrame, keys: list[str], ts: str = "ts", id_col: str = "id", parts: int | None = None
) -> DataFrame:
    """Time to the next mention of the key; the last mention gets the span back to the first."""
    parted = _parted(series, keys, ts, id_col, parts)
    per = _part_counts(parted, keys, ts)
    w = Window.partitionBy(*keys).orderBy(ts)
    dates = (
        per.groupBy(*keys, ts)
        .agg(F.sum("n").alias("n"))
        .withColumn("_next", F.lead(ts).over(w))
        .withColumn("_first", F.first(ts).over(w))
        .select(*keys, ts, "n", F.abs(F.coalesce("_next", "_first") - F.col(ts)).alias("_step"))
    )
    table = _offsets(per, keys, ts).join(dates, [*keys, ts])
    numbered = _numbered(parted, table, keys, ts, id_col)
    is_last = F.col("seq") - F.col("before_date") == F.col("n") - 1
    return numbered.withColumn("gap", F.when(is_last, F.col("_step")).otherwise(F.lit(0))).drop(
        "part", "before", "before_date", "n", "_step"
    )


def gap_counts(series: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Gaps of a key with their number (keys, gap, n), from the date counts alone."""
    w = Window.partitionBy(*keys).orderBy(ts)
    dates = (
        date_counts(series, keys, ts)
        .withColumn("_next", F.lead(ts).over(w))
        .withColumn("_first", F.first(ts).over(w))
    )
    rows = dates.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.abs(F.coalesce("_next", "_first") - F.col(ts)).alias("gap"), F.lit(1).cast("bigint").alias("n")),
                F.struct(F.lit(0).cast("bigint").alias("gap"), (F.col("n") - 1).alias("n")),
            )
        ).alias("x"),
    ).select(*keys, "x.gap", "x.n")
    return rows.filter("n > 0").groupBy(*keys, "gap").agg(F.sum("n").alias("n"))


def frequency_derivative(
    series: DataFrame,
    keys: list[str],
    ts: str = "ts",
    id_col: str = "id",
    parts: int | None = None,
    first_index: int = 3,
) -> DataFrame:
    """Second derivative of the mention frequency before every mention.

    For the mention number ``i >= first_index`` of a key it is the sum of gradient(gradient(h)), where h
    is the 10-bin histogram of the dates of the mentions before it. That sum depends on six cumulative
    counts only, which one running sum over dates and thresholds gives for all mentions: no prefix is
    ever built.
    """
    parted = _parted(series, keys, ts, id_col, parts)
    per = _part_counts(parted, keys, ts)
    w = Window.partitionBy(*keys).orderBy(ts)
    dates = (
        per.groupBy(*keys, ts)
        .agg(F.sum("n").alias("n"))
        .withColumn("start", F.first(ts).over(w))
        .withColumn("span", F.col(ts) - F.col("start"))
    )
    points = F.array(
        F.struct(F.col("span").alias("at"), F.lit(1).alias("kind"), F.lit(0.0).alias("weight"), F.col("n").alias("n")),
        *[
            F.struct(
                # Smallest whole offset that is not below k tenths of the span.
                F.expr(f"({tenth} * span + 9) div 10").alias("at"),
                F.lit(0).alias("kind"),
                F.lit(weight).alias("weight"),
                F.lit(0).cast("bigint").alias("n"),
            )
            for tenth, weight in CURVATURE
        ],
    )
    order = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    terms = (
        dates.select(*keys, ts, "span", F.explode(points).alias("p"))
        .select(*keys, ts, "span", "p.*")
        .withColumn("cum", F.sum("n").over(order))
    )
    own = F.col("kind") == 1
    base = terms.groupBy(*keys, ts).agg(
        F.sum(F.col("weight") * F.when(own, 0).otherwise(F.col("cum"))).alias("lower"),
        F.max(F.when(own, F.col("n"))).alias("n"),
        F.max(F.when(own, F.col("cum") - F.col("n"))).alias("n_before"),
        F.max("span").alias("span"),
    )
    # Value of a prefix that ends with j mentions on this date: base + 1.25 * j, 0 for a single date.
    value = F.when(F.col("span") > 0, F.col("lower") + TOTAL_WEIGHT * F.col("n_before"))
    ends = base.withColumn("base", value).withColumn(
        "end", F.coalesce(F.col("base") + TOTAL_WEIGHT * F.col("n"), F.lit(0.0))
    )
    ends = ends.withColumn("prev_end", F.lag("end").over(w)).select(*keys, ts, "base", "prev_end")
    table = _offsets(per, keys, ts).join(ends, [*keys, ts])
    numbered = _numbered(parted, table, keys, ts, id_col)
    j = F.col("seq") - F.col("before_date")
    deriv = F.when(j == 0, F.col("prev_end")).otherwise(
        F.coalesce(F.col("base") + TOTAL_WEIGHT * j, F.lit(0.0))
    )
    return numbered.withColumn("freq_sec_deriv", F.when(F.col("seq") >= first_index, deriv)).drop(
        "part", "before", "before_date", "base", "prev_end"
    )


def equal_width_histogram(values: DataFrame, keys: list[str], value: str, count: str = "n", bins: int = 10) -> DataFrame:
    """Histogram per key over its own [min, max] of counted values (keys, value, n)."""
    w = Window.partitionBy(*keys)
    ranged = values.withColumn("_lo", F.min(value).over(w)).withColumn("_hi", F.max(value).over(w))
    binned = ranged.withColumn("bin", equal_width_bin(F.col(value), F.col("_lo"), F.col("_hi"), bins))
    return binned.groupBy(*keys, "bin").agg(F.sum(count).alias("n"))


def time_histogram(
    series: DataFrame, keys: list[str], ts: str = "ts", width: int = PROFILE_BIN_SECONDS, fill: bool = True
) -> DataFrame:
    """Mentions per bin of fixed width from the key's first mention, empty bins included."""
    w = Window.partitionBy(*keys)
    counts = date_counts(series, keys, ts).withColumn("_first", F.min(ts).over(w))
    binned = (
        counts.withColumn("bin", F.expr(f"({ts} - _first) div {width}"))
        .groupBy(*keys, "bin")
        .agg(F.sum("n").alias("n"))
    )
    if not fill:
        return binned
    # A bin is followed by zeros up to the next filled one.
    nxt = F.lead("bin").over(Window.partitionBy(*keys).orderBy("bin"))
    gaps = binned.withColumn("_to", F.coalesce(nxt - 1, F.col("bin")))
    return gaps.select(
        *keys, F.explode(F.sequence("bin", "_to")).alias("b"), F.col("bin").alias("_own"), "n"
    ).select(*keys, F.col("b").alias("bin"), F.when(F.col("b") == F.col("_own"), F.col("n")).otherwise(0).alias("n"))


def key_profiles(pairs: DataFrame, keys: list[str], ts: str = "ts", fact: str = "fact") -> DataFrame:
    """All mentions of a key summed up: number, first and last date, whether any is a fact."""
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.coalesce(F.bool_or(fact), F.lit(False)).alias("any_fact"),
    )


def profiled(
    profiles: DataFrame,
    special: Column,
    true_min: int = 500,
    false_min: int = 1000,
    special_min: int = 200,
    plot_min: int = 100,
) -> DataFrame:
    """Keys worth a mention profile, with ``kind`` true or false.

    True keys need more than ``true_min`` mentions or special interest; all others more than
    ``false_min``, or special interest with more than ``special_min``.
    """
    is_true = F.col("any_fact") & ((F.col("n") > true_min) | special)
    is_false = (F.col("n") > false_min) | (special & (F.col("n") > special_min))
    kind = F.when(is_true, "true").when(is_false, "false")
    shown = (F.col("n") >= plot_min) | special
    return profiles.withColumn("kind", kind).filter(F.col("kind").isNotNull() & shown & (F.col("n") > 1))


#: Parts that a range of values is cut into in one round of a selection.
SELECTION_PARTS = 1024


def exact_quantiles(values: DataFrame, keys: list[str], cuts: list[float], value: str = "value") -> DataFrame:
    """(keys, cut, quantile): exact quantiles of a whole-numbered column per key, between ranks by interpolation.

    Selection by refinement. Each wanted rank has a range of values that holds it, at first from the key's least
    to its greatest value. A round cuts every range into ``SELECTION_PARTS`` and counts the rows of each part with
    partial aggregation; the part with the rank is the next range, until it is one value. So a key with most rows
    costs a task at most that many counts per rank, and a round one pass; a span of 2**40 takes four of them.
    ``values`` should be a written table. Null values are left out, null keys are a key.
    """
    rows = values.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("long").alias("_v"))
    spans = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    listed = F.array(*[F.lit(float(c)) for c in cuts])
    wanted = spans.withColumn("cut", F.explode(listed)).withColumn("_at", F.col("cut") * (F.col("_n") - 1))
    wanted = written(wanted.withColumn("_part", F.col("_at") - F.floor("_at")), "wanted")
    ranks = wanted.select(*keys, "_low", "_high", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_rank")).distinct()
    state = written(ranks.withColumn("_below", F.lit(0).cast("long")), "ranks")
    same = lambda left, right, columns: [left[c].eqNullSafe(right[c]) for c in columns]
    while not state.filter("_low < _high").isEmpty():
        open_ranges = state.filter("_low < _high").groupBy(*keys).agg(F.collect_list(F.struct("_rank", "_low", "_high", "_below")).alias("_ranges"))
        side, _ = small_side(open_ranges)
        met = rows.join(side, same(rows, side, keys)).select(
            *[rows[c] for c in keys], "_v", F.explode(F.filter("_ranges", lambda r: (F.col("_v") >= r["_low"]) & (F.col("_v") <= r["_high"]))).alias("r")
        )
        width = F.ceil((F.col("r._high") - F.col("r._low") + 1) / SELECTION_PARTS)
        counts = met.groupBy(*keys, "r", F.floor((F.col("_v") - F.col("r._low")) / width).alias("_cell")).agg(F.count("*").alias("_m"))
        upto = F.sum("_m").over(Window.partitionBy(*keys, "r").orderBy("_cell")) + F.col("r._below")
        # Cells are few: at most SELECTION_PARTS a rank.
        cells = counts.withColumns({"_upto": upto, "_width": width}).filter((F.col("r._rank") < F.col("_upto")) & (F.col("r._rank") >= F.col("_upto") - F.col("_m")))
        low = F.col("r._low") + F.col("_cell") * F.col("_width")
        new = cells.select(*keys, low.alias("_low"), F.least(low + F.col("_width") - 1, "r._high").alias("_high"), F.col("r._rank").alias("_rank"), (F.col("_upto") - F.col("_m")).alias("_below"))
        state = written(state.filter("_low = _high").unionByName(new.select(*state.columns)), "ranks")
    found = state.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("_rank").alias("_r"), F.col("_low").alias("_x"))
    on_keys = [wanted[c].eqNullSafe(found[f"_k{i}"]) for i, c in enumerate(keys)]
    both = wanted.join(F.broadcast(found) if fits_broadcast(found) else found, [*on_keys, (found["_r"] == F.floor("_at")) | (found["_r"] == F.ceil("_at"))])
    lower, upper = F.min("_x").cast("double"), F.max("_x").cast("double")
    return both.groupBy(*keys, "cut", "_part").agg((lower + (upper - lower) * F.col("_part")).alias("quantile")).drop("_part")


def distance_distribution(pairs: DataFrame, fact: str = "fact") -> DataFrame:
    """Minimum, quartiles and maximum of the three distances by truth."""
    names = ["low", "q1", "median", "q3", "high"]
    kinds = ["doc_dist", "para_dist", "sent_dist"]
    stored = written(pairs.select(F.col(fact).alias("_fact"), *[F.col(c).cast("long").alias(c) for c in kinds]), "distances")
    long = stored.select("_fact", F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in kinds])).alias("x"))
    found = exact_quantiles(long.select("_fact", "x.*"), ["_fact", "kind"], [0.0, 0.25, 0.5, 0.75, 1.0])
    wanted = [(c, i, name) for c in kinds for i, name in enumerate(names)]
    cells = [F.max(F.when((F.col("kind") == c) & (F.col("cut") == i / 4), F.col("quantile"))).alias(f"{c}_{name}") for c, i, name in wanted]
    counts = stored.groupBy("_fact").agg(F.count("*").alias("n"))
    cuts = found.groupBy(F.col("_fact").alias("_own")).agg(*cells)
    joined = counts.join(cuts, counts["_fact"].eqNullSafe(cuts["_own"]), "left")
    return joined.select(F.col("_fact").alias(fact), "n", *[f"{c}_{name}" for c, _, name in wanted])


def monthly(rows: DataFrame, day: str = "pub_date", measure: Column | None = None) -> DataFrame:
    """Corpus size per month; undated rows are left out."""
    n = F.count("*") if measure is None else F.sum(measure)
    return (
        rows.filter(F.col(day).isNotNull())
        .groupBy(F.trunc(day, "month").alias("month"))
        .agg(n.alias("n"))
    )


def trailing_windows(months: DataFrame, depths: dict[str, int] | None = None) -> DataFrame:
    """Corpus size of the trailing windows that end in each month of the corpus' own span.

    Works on the month table: a month is sent to the window ends it counts for.
    """
    rows = [
        F.struct(F.lit(k).alias("window"), F.lit(v).alias("depth")) for k, v in (depths or WINDOW_MONTHS).items()
    ]
    last = months.agg(F.max("month")).scalar()
    spread = months.select("month", "n", F.explode(F.array(*rows)).alias("w")).select(
        "w.window",
        "n",
        F.explode(
            F.sequence(
                F.col("month"),
                F.least(F.add_months(F.col("month"), F.col("w.depth") - 1), last),
                F.expr("interval 1 month"),
            )
        ).alias("window_end"),
    )
    return spread.groupBy("window", "window_end").agg(F.sum("n").alias("n"))


def window_members(rows: DataFrame, depth: int, day: str = "pub_date") -> DataFrame:
    """Every row once per trailing window of ``depth`` months that contains it."""
    month = F.trunc(day, "month")
    return rows.filter(F.col(day).isNotNull()).withColumn(
        "window_end", F.explode(F.sequence(month, F.add_months(month, depth - 1), F.expr("interval 1 month")))
    )


def window_distinct(
    rows: DataFrame, term: str, day: str = "pub_date", depths: dict[str, int] | None = None, lg_entries: int | None = None
) -> DataFrame:
    """(window, window_end, n_terms): distinct terms of every trailing window and of all text up to each month.

    Exact unless ``lg_entries`` is given. Every row is read once. A term's months are counted as (month, the next
    month that has it), which is a table as large as the calendar squared: from its month on, a term counts for
    the ends that the window reaches, up to the next month that has the term. So what is shuffled is a row per
    distinct term and month, and what a window costs does not depend on the text.

    With ``lg_entries``, a month is a theta sketch of at most ``2 ** lg_entries`` hashes instead, whose standard error
    is ``2 ** (-lg_entries / 2)`` beyond so many terms.
    Undated rows and null terms are left out. Windows end in the months from the corpus' first to its last.
    """
    dated = rows.filter(F.col(day).isNotNull() & F.col(term).isNotNull()).select(F.trunc(day, "month").alias("month"), F.col(term).alias("term"))
    if lg_entries is None:
        following = F.lead("month").over(Window.partitionBy("term").orderBy("month"))
        gaps = dated.distinct().select("month", following.alias("following")).groupBy("month", "following")
        months = written(gaps.agg(F.count("*").alias("n")), "months")
        total = F.sum("n")
    else:
        sketch = F.theta_sketch_agg("term", lg_entries).alias("n")
        months = written(dated.groupBy("month", F.lit(None).cast("date").alias("following")).agg(sketch), "months")
        total = F.round(F.theta_sketch_estimate(F.theta_union_agg("n", lg_entries))).cast("long")
    last = months.agg(F.max("month")).scalar()
    ends = [F.struct(F.lit(k).alias("window"), F.add_months("month", v - 1).alias("upto")) for k, v in (depths or WINDOW_MONTHS).items()]
    ends.append(F.struct(F.lit("cumulative").alias("window"), last.alias("upto")))
    panes = months.select("month", "following", "n", F.explode(F.array(*ends)).alias("w"))
    upto = F.least("w.upto", F.add_months("following", -1), last)
    spread = panes.select("w.window", "n", F.explode(F.sequence("month", upto, F.expr("interval 1 month"))).alias("window_end"))
    return spread.groupBy("window", "window_end").agg(total.alias("n_terms"))


def cumulative_windows(months: DataFrame, min_size: int = 0) -> DataFrame:
    """Corpus size up to each month; months below ``min_size`` are left out.

    The window runs over the month table, which is as long as the calendar.
    """
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return months.select("month", F.sum("n").over(w).alias("n_until")).filter(F.col("n_until") >= min_size)


def model_grid(months: DataFrame) -> DataFrame:
    """Training parameters: every trailing window per month and the cumulative one per year, both modes."""
    modes = F.array(F.lit("word"), F.lit("bigram"))
    trailing = months.select(
        F.explode(F.array(*[F.lit(k) for k in WINDOW_MONTHS])).alias("window"),
        F.date_format("month", "yyyy-MM").alias("until"),
    )
    cumulative = months.select(
        F.lit("cumulative").alias("window"), F.date_format("month", "yyyy").alias("until")
    ).distinct()
    return trailing.unionByName(cumulative).withColumn("mode", F.explode(modes))


def remaining(params: DataFrame, done: DataFrame) -> DataFrame:
    """Parameters without an existing output."""
    return params.join(done, params.columns, "left_anti")


def neighbour_windows(
    series: DataFrame,
    keys: list[str],
    value: str,
    n: int = 3,
    ts: str = "ts",
    id_col: str = "id",
    parts: int | None = None,
) -> DataFrame:
    """Full windows of ``n`` neighbours in series order (keys, last_seq, window ARRAY).

    Each row is sent to the n windows it belongs to, so a window holds n rows whatever the series' size.
    """
    numbered = mention_series(series, keys, ts, id_col, parts)
    spread = numbered.select(
        *keys,
        "seq",
        F.col(value).alias("value"),
        F.explode(F.sequence(F.col("seq"), F.col("seq") + n - 1)).alias("last_seq"),
    )
    return (
        spread.groupBy(*keys, "last_seq")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "value"))).alias("_w"))
        .filter(F.size("_w") == n)
        .filter(F.element_at("_w", -1)["seq"] == F.col("last_seq"))
        .select(*keys, "last_seq", F.transform("_w", lambda x: x["value"]).alias("window"))
    )
