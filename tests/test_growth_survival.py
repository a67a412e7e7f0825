"""Studies at several targets share what does not depend on the target."""

import datetime as dt
import random

from pitspark.operators import portfolio as pf
from pitspark.plans import studies as sd


def test_outcomes_of_all_targets_in_one_pass_and_shared_closes(spark):
    rng = random.Random(2)
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)
    bars = [(f"t{k}", day(p), p, *[rng.uniform(90, 110) if rng.random() > 0.1 else None] * 4) for k in range(4) for p in range(40)]
    grid = spark.createDataFrame(bars, "ticker string, date date, pos int, open double, high double, low double, close double")
    cal = grid.select("date", "pos").distinct()
    cand = spark.createDataFrame([(day(p), f"t{k}", p) for k in range(4) for p in (1, 5, 9)], "date date, ticker string, pos int")
    breaks = spark.createDataFrame([("t1", day(12))], "ticker string, break_date date")
    run = lambda *targets: sd.survival_outcomes(cand, grid, cal, breaks, targets, 20)
    both, one = run(0.02, 0.05).collect(), [*run(0.02).collect(), *run(0.05).collect()]
    assert both and sorted(map(str, both)) == sorted(map(str, one))
    trades = spark.createDataFrame([("a", f"t{k}", 3 + k, 15, 100.0, 101.0, 0.0) for k in range(4)], "scenario string, ticker string, entry_pos int, exit_pos int, entry_price double, exit_price double, strength double")
    show = lambda closes: sorted(map(str, pf.calendar_time_portfolio(trades, closes, cal).select("pos", "ret", "open_trades").collect()))
    assert len(show(grid)) > 5 and show(pf.held_closes(grid)) == show(grid)
