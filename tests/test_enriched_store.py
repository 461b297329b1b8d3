"""The store of enriched sales: refreshes, statistics, lost runs, and the refit that reads it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillcast.operators import forecast
from tillcast.plans.forecasting import KEPT_RUNS, refit_changed, refresh_forecast
from tillcast.plans.ingest import refresh_enriched
from tillcast.session import run_dir
from tillcast.sources import schemas
from tillcast.sources.enriched_store import EnrichedStore, month_statistics
from tillcast.sources.fact_store import folder_of

MAP = [("W1", "north"), ("W2", "north"), ("W3", "south")]
FIRST = dt.date(2024, 1, 1)


@pytest.fixture
def tables(spark):
    branch_map = spark.createDataFrame(MAP, "code string, branch string")
    places = spark.createDataFrame(
        [("north", "A", 1.0, 2.0), ("south", "B", 3.0, 4.0)],
        "branch string, city string, latitude double, longitude double")
    weather = spark.createDataFrame(
        [(FIRST + dt.timedelta(days=n), 1.0, 2.0, float(n), float(n % 5)) for n in range(90)],
        schemas.WEATHER)
    return branch_map, places, weather


def lines(spark, days, quantity=lambda n, w: float(1 + (n + len(w)) % 4)):
    found = [(dt.datetime.combine(FIRST + dt.timedelta(days=n), dt.time(9)), "cakes", "plain", w,
              quantity(n, w)) for n in days for w in ("W1", "W2", "W3", "W9")]
    return spark.createDataFrame(found, schemas.INVOICE_ITEM)


def store(spark):
    return EnrichedStore(spark, run_dir(spark, "test-enriched"))


def test_a_first_load_shuffles_bare_sums(spark, tables, monkeypatch):
    """Rows are laid out by month before they are enriched, not with all that they gain."""
    seen = []
    create = EnrichedStore.create
    monkeypatch.setattr(
        EnrichedStore, "create", lambda self, rows, *args, **kw: (seen.append(rows), create(self, rows, *args, **kw))
    )
    own = store(spark)
    assert refresh_enriched(lines(spark, range(40)), *tables, own)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan
    assert "temperature" not in plan.split("RebalancePartitions")[1].split("LogicalRDD")[0]
    paths = own.facts.read().select("month", F.input_file_name()).distinct().collect()
    assert len(paths) == len({p[0] for p in paths}) == 2


def test_refreshed_equals_rebuilt(spark, tables, rows):
    grown, whole = store(spark), store(spark)
    assert refresh_enriched(lines(spark, range(40)), *tables, grown)
    january = {r[0] for r in grown.facts.read().filter("month = '2024-01'")
               .select(F.input_file_name()).collect()}
    assert refresh_enriched(lines(spark, range(70)), *tables, grown)
    refresh_enriched(lines(spark, range(70)), *tables, whole)
    assert rows(grown.read()) == rows(whole.read()) and grown.read().count() == 210
    assert rows(grown.statistics.read()) == rows(whole.statistics.read())
    assert january == {r[0] for r in grown.facts.read().filter("month = '2024-01'")
                       .select(F.input_file_name()).collect()}
    assert not refresh_enriched(lines(spark, range(70)).filter("false"), *tables, grown)


def test_statistics_equal_the_facts(spark, tables, rows):
    kept = store(spark)
    refresh_enriched(lines(spark, range(50)), *tables, kept)
    means = spark.range(1).select(kept.means().alias("m")).select("m.*").first()
    exact = kept.read().agg(F.avg("temperature_2m_max"), F.avg("temperature_2m_min")).first()
    assert tuple(means) == pytest.approx(tuple(exact))
    assert rows(kept.series(), "branch", "n_rows", "last_date") == [
        (b, 50, FIRST + dt.timedelta(days=49)) for b in ("W9", "north", "south")]


def test_without_any_weather_there_is_no_mean(spark, tables):
    kept = store(spark)
    refresh_enriched(lines(spark, range(3)), *tables[:2], tables[2].filter("false"), kept)
    assert tuple(spark.range(1).select(kept.means().alias("m")).select("m.*").first()) == (None, None)


@pytest.mark.parametrize("whole", [True, False])
def test_a_lost_refresh_is_finished_or_undone(spark, tables, rows, whole):
    kept = store(spark)
    refresh_enriched(lines(spark, range(10)), *tables, kept)
    before = rows(kept.read())
    staging = f"{kept.path}/staging/left"
    changed = kept.read().withColumn("qty_sold", F.lit(99.0))
    kept.facts.stage(changed, f"{staging}/facts")
    if whole:
        kept.statistics.stage(
            month_statistics(kept.facts.staged(f"{staging}/facts")), f"{staging}/statistics")
    kept.recover()
    assert (rows(kept.read()) == before) != whole
    assert rows(kept.statistics.read()) == rows(month_statistics(kept.facts.read())
                                                .select(kept.statistics.read().columns))
    kept.recover()  # nothing is left


def test_only_changed_series_are_fitted_again(spark, tables, rows, monkeypatch):
    kept, path = store(spark), run_dir(spark, "test-refit")
    refresh_enriched(lines(spark, range(30)), *tables, kept)
    first = rows(refit_changed(spark, kept, path))
    assert first == rows(forecast.forecast_forward(kept.read(), means=kept.means()))
    runs = spark.read.parquet(f"{path}/served").count()
    assert rows(refit_changed(spark, kept, path)) == first
    assert spark.read.parquet(f"{path}/served").count() == runs  # nothing new, nothing written
    more = lines(spark, range(33)).filter("warehouse = 'W3' OR creation < '2024-01-31'")
    refresh_enriched(more, *tables, kept)
    second = refit_changed(spark, kept, path)
    south = second.filter("branch = 'south'")
    assert south.agg(F.min("date")).first()[0] == FIRST + dt.timedelta(days=33)
    assert rows(second.filter("branch <> 'south'")) == [r for r in first if "south" not in r]
    assert second.count() == len(first)


def test_old_and_lost_runs_leave_no_folders(spark, rows):
    path = run_dir(spark, "test-runs")
    made = [(FIRST + dt.timedelta(days=n), "n", "g", "a", float(n % 3)) for n in range(12)]
    enriched = spark.createDataFrame([(*r, "Monday", False, 1.0, 2.0) for r in made], schemas.ENRICHED)
    held = None
    for k in range(6):
        spark.range(1).write.parquet(f"{path}/runs/lost{k}")
        before, held = held, refresh_forecast(spark, True, enriched, path)
        if before is not None:
            assert rows(before) == rows(held)  # a reader of the last run goes on reading
    root, files = folder_of(spark, f"{path}/runs")
    assert len(files.listStatus(root)) == KEPT_RUNS
    assert rows(refresh_forecast(spark, False, enriched, path)) == rows(held)
