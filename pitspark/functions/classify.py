"""Scalar state rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def any_null(*cols: Column) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | c.isNull()
    return out


def price_trend(price, fast_ma, slow_ma) -> Column:
    p, f, s = _c(price), _c(fast_ma), _c(slow_ma)
    ups = (p > f).cast("int") + (p > s).cast("int") + (f > s).cast("int")
    return (F.when(any_null(p, f, s), "INSUFFICIENT_DATA").when(ups == 3, "BULLISH")
            .when(ups == 0, "BEARISH").otherwise("MIXED"))


def momentum_state(*returns) -> Column:
    known = F.array_compact(F.array(*[_c(r) for r in returns]))
    return (F.when(F.size(known) == 0, "INSUFFICIENT_DATA")
            .when(F.forall(known, lambda v: v > 0), "BULLISH")
            .when(F.forall(known, lambda v: v < 0), "BEARISH").otherwise("MIXED"))


def rsi_state(value) -> Column:
    v = _c(value)
    return F.when(v.isNull(), "INSUFFICIENT_DATA").when(v >= 70, "OVERBOUGHT").when(v <= 30, "OVERSOLD").otherwise("NEUTRAL")


def volatility_regime(current, history) -> Column:
    """Tercile of an instrument's own history (array column); ten known values are needed."""
    h, cur = F.array_sort(F.array_compact(_c(history))), _c(current)
    n = F.size(h)
    low = F.get(h, F.floor(n / 3).cast("int"))
    high = F.get(h, F.floor(2 * n / 3).cast("int"))
    return (F.when(cur.isNull() | (n < 10), "INSUFFICIENT_DATA").when(cur <= low, "LOW")
            .when(cur >= high, "HIGH").otherwise("NORMAL"))


def trend_state(values, tolerance: float = 0.02, higher_is_better: bool = True) -> Column:
    """Trend of an oldest-first array: the mean step and the last step must not contradict."""
    v = F.array_compact(_c(values))
    n, sign = F.size(v), (1 if higher_is_better else -1)
    mean_step = sign * (F.get(v, n - 1) - F.get(v, F.lit(0))) / (n - 1)
    last_step = sign * (F.get(v, n - 1) - F.get(v, n - 2))
    return (F.when(n < 2, "INSUFFICIENT_DATA")
            .when((mean_step > tolerance) & (last_step >= -tolerance), "IMPROVING")
            .when((mean_step < -tolerance) & (last_step <= tolerance), "DETERIORATING").otherwise("STABLE"))


def volume_trend(values) -> Column:
    state = trend_state(values)
    return F.when(state == "IMPROVING", "INCREASING").when(state == "DETERIORATING", "DECREASING").otherwise(state)


def valuation_context(pe, forward_pe) -> Column:
    p, f = _c(pe), _c(forward_pe)
    change = (f - p) / p
    return (F.when(any_null(p, f) | (p <= 0), "INSUFFICIENT_DATA").when(change <= -0.05, "IMPROVING")
            .when(change >= 0.05, "DETERIORATING").otherwise("STABLE"))


def _clamped(days) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(7300), _c(days).cast("int")))


def horizon_category(days) -> Column:
    d = _clamped(days)
    return (F.when(d <= 5, "very_short_term").when(d <= 90, "short_term").when(d <= 730, "medium_term").otherwise("long_term"))


def horizon_profile(days) -> Column:
    d = _clamped(days)
    return (F.when(d <= 3, "VERY_SHORT").when(d <= 14, "SHORT").when(d <= 182, "MEDIUM").when(d <= 730, "LONG")
            .otherwise("VERY_LONG"))


def score_label(score) -> Column:
    s = _c(score)
    return (F.when(s.isNull() | F.isnan(s), "Insufficient data").when(s >= 0.30, "Strong").when(s >= 0.10, "Favorable")
            .when(s <= -0.10, "Unfavorable").otherwise("Neutral"))


def view_label(score) -> Column:
    s = _c(score)
    return (F.when(s.isNull(), "INSUFFICIENT_EVIDENCE").when(s > 0.15, "POSITIVE").when(s < -0.15, "NEGATIVE")
            .otherwise("NEUTRAL"))


# Upper SIC code of each division.
SIC_UPPER_BOUNDS = [
    (999, "agriculture"), (1499, "mining"), (1799, "construction"), (3999, "manufacturing"),
    (4999, "transport_utilities"), (5199, "wholesale"), (5999, "retail"), (6799, "finance"), (8999, "services"),
]


def sic_division(sic) -> Column:
    s = _c(sic)
    out = F.when(s.isNull(), "unknown")
    for upper, name in SIC_UPPER_BOUNDS:
        out = out.when(s <= upper, name)
    return out.otherwise("public_admin")


# Country to region.
REGION_OF_COUNTRY = {
    "United States": "North America", "Canada": "North America", "Mexico": "North America",
    "United Kingdom": "Europe", "Germany": "Europe", "France": "Europe", "Switzerland": "Europe", "Netherlands": "Europe", "Spain": "Europe", "Italy": "Europe",
    "Sweden": "Europe", "Ireland": "Europe", "Belgium": "Europe", "Denmark": "Europe", "Norway": "Europe", "Finland": "Europe",
    "Japan": "Asia", "China": "Asia", "South Korea": "Asia", "Taiwan": "Asia", "India": "Asia", "Singapore": "Asia", "Hong Kong": "Asia",
    "Australia": "Oceania", "New Zealand": "Oceania",
    "Brazil": "Latin America", "Argentina": "Latin America", "Chile": "Latin America",
}


def region_of_country(country) -> Column:
    c = _c(country)
    regions = F.create_map(*[F.lit(x) for pair in REGION_OF_COUNTRY.items() for x in pair])
    return F.when(c != "", F.coalesce(F.try_element_at(regions, c), F.lit("Other")))


# Days before a source counts as stale, by horizon category (price, fundamentals, institutional).
STALE_AFTER_DAYS = {
    "very_short_term": (1, 200, 400), "short_term": (5, 200, 400),
    "medium_term": (20, 200, 400), "long_term": (90, 400, 800),
}


def _limit(category: Column, slot: int) -> Column:
    out = F.lit(None).cast("int")
    for name, limits in STALE_AFTER_DAYS.items():
        out = F.when(category == name, limits[slot]).otherwise(out)
    return out


def freshness(category, now, price_date, fundamental_date, institutional_date) -> Column:
    """Struct of three stale flags and a status; prices decide short horizons, reports decide long ones."""
    cat = _c(category)
    stale = [F.coalesce(F.datediff(_c(now), _c(d)) > _limit(cat, i), F.lit(False))
             for i, d in enumerate((price_date, fundamental_date, institutional_date))]
    overall = F.when(cat.isin("very_short_term", "short_term"), stale[0]).otherwise(stale[1] | stale[2])
    return F.struct(stale[0].alias("price_stale"), stale[1].alias("fundamentals_stale"),
                    stale[2].alias("institutional_stale"), F.when(overall, "STALE").otherwise("OK").alias("status"))


def chart_window(days) -> Column:
    d = _c(days)
    return (F.when(d <= 3, "5 minutes").when(d <= 14, "30 minutes").when(d <= 730, "1 day").otherwise("1 week"))


def direction_value(direction) -> Column:
    d = _c(direction)
    return F.when(d == "POSITIVE", 1.0).when(d == "NEGATIVE", -1.0).when(d.isin("NEUTRAL", "MENTIONED"), 0.0)


def direction_label(mean_score: Column, any_directional: Column) -> Column:
    return (F.when(mean_score > 0.25, "POSITIVE").when(mean_score < -0.25, "NEGATIVE")
            .when(any_directional, "NEUTRAL").otherwise("MENTIONED"))


def normal_cdf(z) -> Column:
    """Standard normal distribution function by the Hart/West double-precision rational form."""
    x = F.abs(_c(z))
    e = F.exp(-x * x / 2)
    num = [3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931,
           220.206867912376]
    den = [8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
           793.826512519948, 440.413735824752]
    def poly(coeffs: Sequence[float]) -> Column:
        out = F.lit(coeffs[0])
        for c in coeffs[1:]:
            out = out * x + c
        return out
    far = e / (x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))) / 2.506628274631
    upper = F.when(x > 37, 0.0).when(x < 7.07106781186547, e * poly(num) / poly(den)).otherwise(far)
    return F.when(_c(z) > 0, 1 - upper).otherwise(upper)


def normal_ppf(p) -> Column:
    """Standard normal quantile by Wichura's AS 241 rational approximations (double precision)."""
    p = _c(p)
    # The published coefficients, highest power first.
    central = ([2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
                13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608],
               [5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
                5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0])
    middle = ([7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
               3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734],
              [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
               0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0])
    tail = ([2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093,
             0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772],
            [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4,
             0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0])

    def ratio(coeffs, x: Column) -> Column:
        parts = []
        for side in coeffs:
            acc = F.lit(side[0])
            for c in side[1:]:
                acc = acc * x + c
            parts.append(acc)
        return parts[0] / parts[1]

    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    far = F.when(r <= 5, ratio(middle, r - 1.6)).otherwise(ratio(tail, r - 5.0))
    return (F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
            .when(F.abs(q) <= 0.425, q * ratio(central, 0.180625 - q * q))
            .when(q < 0, -far).otherwise(far))
