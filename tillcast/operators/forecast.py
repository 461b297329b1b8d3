"""Seven-day forecast of every branch and item: a joint fit with saturating growth, as aggregates.

The model of one series (branch, item) is

    yhat = cap / (1 + exp(-(growth + rate * years))) + sum(weight * term)

cap is the most frequent quantity, years count from the series' first quarter, by quarter. The terms are
an offset, a week in sines and cosines of order 3, one indicator per holiday, and the regressors,
each brought to mean 0 and deviation 1 within its series. All weights and both growth
numbers are fitted together by least squares with a small ridge, in Gauss-Newton rounds that solve
the normal equations of all of them.

Nothing of that needs the rows more than once. Per series the rows give the sums of all
products of two terms and, per quarter, the sums of all terms; as the growth curve is constant
within a quarter, every round follows from these. The equations are array columns, solved in a
projection. The rows are shuffled by series a single time (``by_series``); every later step
groups, ranks or joins on the same keys, so Spark reuses that shuffle. Rows are at daily grain: a
series has at most one row per calendar day and item group, however many invoice lines stand
behind it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions import calendar, numeric
from tillcast.operators import selection
from tillcast.operators.enrich import TEMPERATURES, fill_mean
from tillcast.sources.schemas import SERIES_KEY

HORIZON = 7
REGRESSORS = ["is_weekend", *TEMPERATURES, "day"]
WEEK_ORDER = 3
#: Added to the diagonal of the normal equations, for terms of deviation 1.
RIDGE = 0.1
#: Rounds for the growth, and the most that a round changes each of its two numbers.
ROUNDS, STEP = 6, 1.0
CONSTANT = 1e-9  # share of the mean square below which a variance is rounding error
MOST_HOLIDAYS = 64  # different names; each is a term of every series
MODEL = ["cap", "growth", "rate", "first_quarter", "last_date", "item_group",
         "weights", "centre", "scale"]

Rows = Callable[[DataFrame], DataFrame]


def training_set(enriched: DataFrame, means: Column | None = None) -> DataFrame:
    """Rows to learn from: weather filled, day of month, excluded branches/items/dates out.

    ``means``: struct of the mean temperatures, where they are known already.
    """
    filled = fill_mean(enriched, TEMPERATURES, means).withColumn(
        "day", calendar.day_of_month(F.col("date"))
    )
    kept = selection.exclude_branches(filled)
    kept = selection.exclude_items(kept)
    return selection.exclude_dates(kept)


def by_series(rows: DataFrame) -> DataFrame:
    """Rows shuffled by series, into as many partitions as the session says.

    Their number is stated, as Spark would put few bytes into few partitions, while the fit takes
    far longer per byte than reading them.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, *SERIES_KEY)


# --- splitting ---------------------------------------------------------------------------


def _aged(rows: DataFrame) -> DataFrame:
    """Rows by series with ``_age``, 1 for the newest; a window over one series' days."""
    newest = Window.partitionBy(*SERIES_KEY).orderBy(F.desc("date"), F.desc("item_group"))
    return by_series(rows).withColumn("_age", F.row_number().over(newest))


def split_series(rows: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Mark each series' last ``horizon`` rows as test, the others as train.

    Series of at most ``horizon`` rows drop out. The result is partitioned by series.
    """
    size = F.max("_age").over(Window.partitionBy(*SERIES_KEY))
    return (
        _aged(rows)
        .withColumn("_size", size)
        .filter(F.col("_size") > horizon)
        .withColumn("part", F.when(F.col("_age") <= horizon, "test").otherwise("train"))
        .drop("_age", "_size")
    )


def train_part(split: DataFrame) -> DataFrame:
    return split.filter(F.col("part") == "train").drop("part")


def test_part(split: DataFrame) -> DataFrame:
    return split.filter(F.col("part") == "test").drop("part")


def eligible_series(train: DataFrame, minimum: int = 2) -> DataFrame:
    """Series with enough quantities to fit."""
    return (
        train.groupBy(*SERIES_KEY)
        .agg(
            F.count(F.lit(1)).alias("train_rows"),
            F.count("qty_sold").alias("train_values"),
        )
        .filter(F.col("train_values") >= minimum)
    )


def _forecastable(horizon: int, minimum: int = 2) -> Column:
    """Over aged rows of a series: can it be fitted without its last ``horizon`` rows?"""
    older = F.count(F.when(F.col("_age") > horizon, F.col("qty_sold")))
    return (F.count(F.lit(1)) > horizon) & (older >= minimum)


def series_cap(train: DataFrame) -> DataFrame:
    """Most frequent quantity of each series, the smallest on ties."""
    return (
        train.filter(F.col("qty_sold").isNotNull())
        .groupBy(*SERIES_KEY, "qty_sold")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*SERIES_KEY)
        .agg(_most_frequent().alias("cap"))
    )


def _most_frequent() -> Column:
    """Over rows (qty_sold, n): the quantity with the largest n."""
    return -F.max(F.struct("n", (-F.col("qty_sold")).alias("minus")))["minus"]


# --- terms -------------------------------------------------------------------------------


def _quarter_number() -> Column:
    return F.year("date") * 4 + F.quarter("date")


def holiday_names(holidays: DataFrame | None) -> list[str]:
    """The different names, sorted: a term each, so their number is bounded."""
    if holidays is None:
        return []
    found = holidays.select("holiday").distinct().limit(MOST_HOLIDAYS + 1).collect()
    if len(found) > MOST_HOLIDAYS:
        raise ValueError(f"more than {MOST_HOLIDAYS} names of holidays")
    return sorted(r["holiday"] for r in found if r["holiday"] is not None)


def _add_holiday(rows: DataFrame, holidays: DataFrame | None) -> DataFrame:
    """One holiday name per date, the first by name."""
    if holidays is None:
        return rows
    named = holidays.groupBy("date").agg(F.min("holiday").alias("holiday"))
    return rows.join(named, "date", "left")


def _terms(regressors: Sequence[str], names: Sequence[str]) -> list[Column]:
    angle = F.weekday("date") * (2 * math.pi / 7)
    week = [f(angle * k) for k in range(1, WEEK_ORDER + 1) for f in (F.sin, F.cos)]
    feasts = [F.coalesce((F.col("holiday") == n).cast("double"), F.lit(0.0)) for n in names]
    values = [F.coalesce(F.col(r).cast("double"), F.lit(0.0)) for r in regressors]
    return [F.lit(1.0), *week, *feasts, *values]


# --- fitting -----------------------------------------------------------------------------


def _sums(rows: DataFrame, terms: list[Column], keep: Column) -> DataFrame:
    """Per series: ``products``, the sums of all products of two terms, ``with_y``, those of a term
    and the quantity, and last_date, of all rows; ``keep`` is an aggregate that series must meet."""
    p = range(len(terms))
    valid = F.col("qty_sold").isNotNull()
    wide = rows.select(
        *SERIES_KEY, "date", "qty_sold", "_age",
        *(F.when(valid, t).alias(f"z{j}") for j, t in enumerate(terms)),
    )
    products = [F.expr(f"sum(z{j} * z{k}) AS m{j}_{k}") for j in p for k in range(j + 1)]
    with_y = [F.expr(f"sum(z{j} * qty_sold) AS y{j}") for j in p]
    made = wide.groupBy(*SERIES_KEY).agg(
        keep.alias("_keep"), F.max("date").alias("last_date"), *products, *with_y
    )
    lines = (", ".join(f"m{max(j, k)}_{min(j, k)}" for k in p) for j in p)
    return made.filter("_keep").select(
        *SERIES_KEY,
        "last_date",
        F.expr(f"array({', '.join(f'array({line})' for line in lines)}) AS products"),
        F.expr(f"array({', '.join(f'y{j}' for j in p)}) AS with_y"),
    )


def _quarters(rows: DataFrame, terms: list[Column]) -> DataFrame:
    """Per series: first_quarter, and ``quarters``: (years, sums of all terms and the quantity)."""
    names = [f"z{j}" for j in range(len(terms))] + ["qty_sold"]
    per_quarter = (
        rows.filter(F.col("qty_sold").isNotNull())
        .select(*SERIES_KEY, _quarter_number().alias("quarter"), "qty_sold",
                *(t.alias(f"z{j}") for j, t in enumerate(terms)))
        .groupBy(*SERIES_KEY, "quarter")
        .agg(*(F.sum(n).alias(n) for n in names))
    )
    listed = F.array_sort(F.collect_list(F.struct("quarter", F.array(*names).alias("sums"))))
    found = per_quarter.groupBy(*SERIES_KEY).agg(listed.alias("quarters"))
    first = F.col("quarters")[0]["quarter"]
    years = F.transform(
        "quarters", lambda q: F.struct(((q["quarter"] - first) / 4.0).alias("years"), q["sums"])
    )
    return found.select(*SERIES_KEY, first.alias("first_quarter"), years.alias("quarters"))


def _caps(rows: DataFrame) -> DataFrame:
    """Per series: cap and the item group of its first row."""
    place = F.struct("date", "item_group")
    n = F.count("qty_sold").alias("n")
    per_quantity = rows.groupBy(*SERIES_KEY, "qty_sold").agg(n, F.min(place).alias("first"))
    return per_quantity.groupBy(*SERIES_KEY).agg(
        _most_frequent().alias("cap"), F.min("first")["item_group"].alias("item_group")
    )


# Expressions on array columns are written as SQL text: lambdas inside lambdas, one per line.


def _let(value: str, name: str, body: str) -> str:
    """``body`` of a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def inverse(matrix: str, size: int) -> str:
    """Inverse of a matrix of ``size`` lines, as lines.

    Elimination without exchanges, which symmetric equations with a ridge don't need.
    """
    unit = "transform(line, (_, c) -> if(i = c, 1D, 0D))"
    start = f"transform({matrix}, (line, i) -> concat(line, {unit}))"
    scaled = _let("pivot[j]", "d", "transform(pivot, x -> x / d)")
    reduced = _let("line[j] / pivot[j]", "f", "zip_with(line, pivot, (x, q) -> x - f * q)")
    lines = f"transform(lines, (line, i) -> if(i = j, {scaled}, {reduced}))"
    step = _let("lines[j]", "pivot", lines)
    done = f"aggregate(sequence(0, {size - 1}), {start}, (lines, j) -> {step})"
    return f"transform({done}, line -> slice(line, {size + 1}, {size}))"


def _dot(first: str, second: str) -> str:
    products = f"zip_with({first}, {second}, (x, y) -> x * y)"
    return f"aggregate({products}, 0D, (total, x) -> total + x)"


def _times(lines: str, vector: str) -> str:
    return f"transform({lines}, line -> {_dot('line', vector)})"


def _standardised(sums: DataFrame, p: int, regressors: int) -> DataFrame:
    """The sums for regressors of mean 0 and deviation 1; those that hardly vary become 0.

    Adds ``inner``, the inverse of the sums of products with the ridge."""
    plain = p - regressors
    n = "products[0][0]"
    centre = [f"if({j} < {plain}, 0D, products[{j}][0] / {n})" for j in range(p)]
    spread = [f"products[{j}][{j}] / {n} - pow(products[{j}][0] / {n}, 2)" for j in range(p)]
    scale = [
        f"if({j} < {plain}, 1D, if({s} > {CONSTANT} * products[{j}][{j}] / {n}, 1 / sqrt({s}), 0D))"
        for j, s in enumerate(spread)
    ]
    sums = sums.select(
        "*", F.expr(f"array({', '.join(centre)}) AS centre"), F.expr(f"array({', '.join(scale)}) AS scale")
    )

    def moved(values: str, total: str) -> str:
        """Sums of a value with each term, brought to the standard terms."""
        return f"transform({values}, (v, k) -> (v - centre[k] * {total}) * scale[k])"

    # the columns first, then the lines
    lines = f"transform(products, line -> {moved('line', 'line[0]')})"
    line = "zip_with(line, square[0], (v, h) -> (v - centre[i] * h) * scale[i])"
    ridged = f"transform({line}, (v, k) -> v + if(i = k, {RIDGE}D, 0D))"
    matrix = _let(lines, "square", f"transform(square, (line, i) -> {ridged})")
    moved_quarter = moved(f"slice(q.sums, 1, {p})", "q.sums[0]")
    quarter = f"struct(q.years AS years, concat({moved_quarter}, slice(q.sums, {p + 1}, 1)) AS sums)"
    return sums.withColumns(
        {
            "inner": F.expr(inverse(matrix, p)),
            "with_y": F.expr(moved("with_y", "with_y[0]")),
            "quarters": F.expr(f"transform(quarters, q -> {quarter})"),
        }
    )


def _growth_sums(growth: str, rate: str, p: int) -> str:
    """Over the quarters: sums of all terms and the quantity times the curve and its slopes in growth and
    rate (``curve``, ``by_growth``, ``by_rate``), and ``squares``: of the slopes with themselves,
    each other and the curve."""
    zeros = f"array_repeat(0D, {p + 1})"
    start = (
        f"struct({zeros} AS curve, {zeros} AS by_growth, {zeros} AS by_rate,"
        " array_repeat(0D, 5) AS squares)"
    )

    def plus(name: str, factor: str) -> str:
        return f"zip_with(sums.{name}, q.sums, (x, v) -> x + ({factor}) * v) AS {name}"

    slope = "cap * s * (1 - s)"
    squares = (
        f"array(pow({slope}, 2), pow({slope}, 2) * q.years, pow({slope} * q.years, 2),"
        f" {slope} * cap * s, {slope} * q.years * cap * s)"
    )
    added = (
        f"struct({plus('curve', 'cap * s')}, {plus('by_growth', slope)},"
        f" {plus('by_rate', f'{slope} * q.years')},"
        f" zip_with(sums.squares, {squares}, (x, v) -> x + q.sums[0] * v) AS squares)"
    )
    share = f"1 / (1 + exp(-({growth} + {rate} * q.years)))"
    return f"aggregate(quarters, {start}, (sums, q) -> {_let(share, 's', added)})"


def _changes(growth: str, rate: str, p: int) -> str:
    """What the normal equations of both growth numbers' changes and all weights say of the changes.

    The weights' part of the equations stays the same, so with its inverse ``inner`` they are
    eliminated, and two equations are left. ``sums``: from ``_growth_sums``.
    """
    first, second = (f"slice(sums.{c}, 1, {p})" for c in ("by_growth", "by_rate"))
    rest = f"zip_with(with_y, slice(sums.curve, 1, {p}), (y, c) -> y - c)"
    solved = ", ".join(_times("inner", v) for v in (first, second, rest))
    two = f"""struct(
        sums.squares[0] + {RIDGE}D - {_dot(first, "u[0]")} AS a,
        sums.squares[1] - {_dot(first, "u[1]")} AS b,
        sums.squares[2] + {RIDGE}D - {_dot(second, "u[1]")} AS c,
        sums.by_growth[{p}] - sums.squares[3] - {RIDGE}D * {growth} - {_dot(first, "u[2]")} AS g,
        sums.by_rate[{p}] - sums.squares[4] - {RIDGE}D * {rate} - {_dot(second, "u[2]")} AS r)"""
    changes = "array((e.c * e.g - e.b * e.r), (e.a * e.r - e.b * e.g))"
    ruled = f"transform({changes}, x -> x / (e.a * e.c - e.b * e.b))"
    return _let(f"array({solved})", "u", _let(two, "e", ruled))


def _fitted(sums: DataFrame, p: int) -> DataFrame:
    """Growth numbers by rounds, then the weights for the last ones."""
    moves = [
        f"now.{name} + greatest(-{STEP}D, least({STEP}D, c[{k}])) AS {name}"
        for k, name in enumerate(("growth", "rate"))
    ]
    moved = _let(_changes("now.growth", "now.rate", p), "c", f"struct({', '.join(moves)})")
    advance = _let(_growth_sums("now.growth", "now.rate", p), "sums", moved)
    start = "struct(0D AS growth, 0D AS rate)"
    curve = f"aggregate(sequence(1, {ROUNDS}), {start}, (now, _) -> {advance})"
    rest = f"zip_with(with_y, slice(sums.curve, 1, {p}), (y, c) -> y - c)"
    weights = _let(_growth_sums("growth", "rate", p), "sums", _times("inner", rest))
    return (
        sums.withColumn("_curve", F.expr(curve))
        .withColumns({"growth": F.col("_curve.growth"), "rate": F.col("_curve.rate")})
        .withColumn("weights", F.expr(weights))
    )


def _fit(
    aged: DataFrame, keep: Column, regressors: Sequence[str], holidays: DataFrame | None
) -> DataFrame:
    """Model rows of the series that meet ``keep``, from aged rows by series."""
    terms = _terms(regressors, holiday_names(holidays))
    rows = _add_holiday(aged, holidays)
    sums = (
        _sums(rows, terms, keep)
        .join(_quarters(rows, terms), SERIES_KEY)
        .join(_caps(aged), SERIES_KEY)
    )
    fitted = _fitted(_standardised(sums, len(terms), len(regressors)), len(terms))
    ends = f"{len(terms) - len(regressors) + 1}, {len(regressors)}"
    slopes = f"slice(zip_with(weights, scale, (w, s) -> w * s), {ends}) AS regressor_slope"
    return fitted.select(*SERIES_KEY, *MODEL, F.expr(slopes))


def fit(
    rows: DataFrame,
    regressors: Sequence[str] = REGRESSORS,
    holidays: DataFrame | None = None,
    minimum: int = 2,
) -> DataFrame:
    """One model row per series with at least ``minimum`` quantities.

    ``holidays`` has columns date and holiday. regressor_slope: the regressors' weights in their own
    units. A regressor that hardly varies within the series has slope 0.
    """
    return _fit(_aged(rows), F.count("qty_sold") >= minimum, regressors, holidays)


# --- predicting --------------------------------------------------------------------------


def future_dates(model: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """The model rows repeated for each of the days after the series' last date."""
    day = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    return (
        model.withColumn("_ahead", day)
        .withColumn("date", F.date_add("last_date", F.col("_ahead")))
        .drop("_ahead")
    )


def add_future_regressors(
    frame: DataFrame, training: DataFrame, weather: DataFrame | None = None
) -> DataFrame:
    """Regressors of days not seen yet: calendar by date, temperatures by branch and date.

    ``weather`` has a row per branch and date with TEMPERATURES. Days that it does not know take
    the mean of the training rows.
    """
    means = training.select(F.struct(*[F.avg(c).alias(c) for c in TEMPERATURES])).scalar()
    if weather is None:
        frame = frame.withColumns({c: F.lit(None).cast("double") for c in TEMPERATURES})
    else:
        known = weather.select("branch", "date", *TEMPERATURES)
        frame = frame.join(known, ["branch", "date"], "left")
    return frame.withColumns(
        {
            "is_weekend": calendar.is_weekend(F.col("date")),
            "day": calendar.day_of_month(F.col("date")),
            **{c: F.coalesce(F.col(c), means[c]) for c in TEMPERATURES},
        }
    )


def future_frame(
    training: DataFrame, horizon: int = HORIZON, weather: DataFrame | None = None
) -> DataFrame:
    """History plus the coming days of each eligible series, with cap and regressors."""
    rows = _aged(training)
    keys = rows.groupBy(*SERIES_KEY).agg(
        _forecastable(horizon).alias("_keep"), F.max("date").alias("last_date")
    )
    series = keys.filter("_keep").drop("_keep").join(_caps(rows).drop("item_group"), SERIES_KEY)
    columns = ["date", *SERIES_KEY, "cap", *REGRESSORS]
    history = rows.join(series, SERIES_KEY).select(columns)
    coming = add_future_regressors(future_dates(series, horizon), training, weather)
    return history.unionByName(coming.select(columns))


def predict(
    frame: DataFrame, regressors: Sequence[str] = REGRESSORS, holidays: DataFrame | None = None
) -> DataFrame:
    """Predictions for rows that carry their series' model and the regressors.

    yhat is cut to six decimals first, so that sums in another order round alike.
    """
    years = (_quarter_number() - F.col("first_quarter")) / 4.0
    yhat = F.col("cap") / (1 + F.exp(-(F.col("growth") + F.col("rate") * years)))
    for j, term in enumerate(_terms(regressors, holiday_names(holidays))):
        yhat += (term - F.col("centre")[j]) * F.expr(f"scale[{j}] * weights[{j}]")
    return _add_holiday(frame, holidays).select(
        "date",
        numeric.half_even_int(F.abs(F.round(yhat, 6))).alias("prediction"),
        "item_name",
        "branch",
        "item_group",
    )


def forecast_forward(
    enriched: DataFrame,
    horizon: int = HORIZON,
    regressors: Sequence[str] = REGRESSORS,
    holidays: DataFrame | None = None,
    weather: DataFrame | None = None,
    means: Column | None = None,
    only: Rows | None = None,
) -> DataFrame:
    """Fit on every row of the eligible series and predict the days after each one's last.

    A series is eligible by the rule of the backtest. ``weather``: see ``add_future_regressors``;
    ``means``: see ``training_set``. ``only`` keeps the rows of some whole series, before anything
    is shuffled or fitted; the means of unknown days are still those of all training rows.
    """
    training = training_set(enriched, means)
    chosen = training if only is None else only(training)
    model = _fit(_aged(chosen), _forecastable(horizon), regressors, holidays)
    frame = add_future_regressors(future_dates(model, horizon), training, weather)
    return predict(frame, regressors, holidays)


def forecast_backtest(
    enriched: DataFrame,
    horizon: int = HORIZON,
    regressors: Sequence[str] = REGRESSORS,
    holidays: DataFrame | None = None,
    means: Column | None = None,
) -> DataFrame:
    """Fit on all but the last rows of each series and predict those last rows."""
    rows = _aged(training_set(enriched, means))
    older = rows.filter(F.col("_age") > horizon)
    model = _fit(older, F.count("qty_sold") >= 2, regressors, holidays)
    last = rows.filter(F.col("_age") <= horizon)
    frame = last.drop("qty_sold").join(model.drop("last_date", "item_group"), SERIES_KEY)
    return predict(frame, regressors, holidays)
