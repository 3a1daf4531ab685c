"""Column helpers: keys, months, guards and tiers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

#: Severity of a gap share, from the best on: (least share, whether it must be exceeded, name), and the rest.
ROW_SCALE = (((0.15, True, "EXCESS"), (0.05, True, "BALANCED"), (0.0, False, "LOW"), (-0.03, False, "MEDIUM"), (-0.08, False, "HIGH")), "CRITICAL", "UNKNOWN")
ROLLUP_SCALE = (((0.05, False, "EXCESS"), (0.0, False, "BALANCED"), (-0.03, False, "LOW"), (-0.08, False, "MEDIUM"), (-0.15, False, "HIGH")), "CRITICAL", "EXCESS")
SEVERITY_SCORES = {"CRITICAL": 6, "HIGH": 5, "MEDIUM": 4, "LOW": 3, "BALANCED": 2, "EXCESS": 1}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# keys


def md5_strict(*parts: Column | str) -> Column:
    """md5 of the parts joined by ``|``; NULL if any part is NULL."""
    texts = [col(p).cast("string") for p in parts]
    return F.md5(F.concat(*chain.from_iterable((F.lit("|"), t) for t in texts)).substr(F.lit(2), F.lit(2**30)))


def md5_key(*parts: Column | str) -> Column:
    """md5 of the parts joined by ``|``, with NULL written as the word NULL."""
    return F.md5(F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("NULL")) for p in parts]))


def join_key(*parts: Column | str) -> Column:
    return F.concat(*list(chain.from_iterable((F.lit("|"), col(p).cast("string")) for p in parts))[1:])


# months: integers yyyymm


def month_key(date: Column | str) -> Column:
    return (F.year(col(date)) * 100 + F.month(col(date))).cast("int")


def month_start(key: Column | str) -> Column:
    return F.make_date(F.floor(col(key) / 100).cast("int"), (col(key) % 100).cast("int"), F.lit(1))


def month_number(key: Column | str) -> Column:
    """Months since year 0: differences count months."""
    return (F.floor(col(key) / 100) * 12 + col(key) % 100).cast("int")


def month_from_number(n: Column | str) -> Column:
    return (F.floor((col(n) - 1) / 12) * 100 + (col(n) - 1) % 12 + 1).cast("int")


def add_months(key: Column | str, n: Column | int) -> Column:
    return month_from_number(month_number(key) + n)


def month_label(key: Column | str) -> Column:
    """202301 as jan_2023."""
    return F.lower(F.date_format(month_start(key), "MMM_yyyy"))


def month_of_label(label: Column | str) -> Column:
    number = F.create_map(*chain.from_iterable((F.lit(m), F.lit(i)) for i, m in enumerate(MONTHS, 1)))
    return (F.substring(col(label), 5, 4).cast("int") * 100 + number[F.substring(col(label), 1, 3)]).cast("int")


def month_range(first: Column | str, last: Column | str) -> Column:
    """All months of an inclusive range, as an array."""
    numbers = F.sequence(month_number(first), month_number(last))
    return F.transform(numbers, month_from_number)


def data_type(key: Column | str, cutoff: int) -> Column:
    return F.when(col(key) <= cutoff, "ACTUAL").otherwise("FORECAST")


def calendar_features(key: Column | str, cutoff: int) -> dict[str, Column]:
    month = (col(key) % 100).cast("int")
    return {
        "month_of_year": month,
        "quarter": F.ceil(month / 3).cast("int"),
        "year": F.floor(col(key) / 100).cast("int"),
        "is_quarter_end": F.when(month % 3 == 0, 1).otherwise(0),
        "is_actual": F.when(col(key) <= cutoff, 1).otherwise(0),
    }


# guards


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """c kept within bounds; NULL stays NULL."""
    out = col(c)
    out = F.when(out < low, F.lit(low)).otherwise(out) if low is not None else out
    return F.when(out > high, F.lit(high)).otherwise(out) if high is not None else out


def default(c: Column | str, value, zero_too: bool = False) -> Column:
    """value in place of NULL, and of 0 if zero_too."""
    return F.coalesce(F.nullif(col(c), F.lit(0.0)) if zero_too else col(c), F.lit(value))


def consistent(passed: Column | str, failed: Column | str, total: Column | str, slack: float = 1) -> Column:
    return F.abs(col(passed) + col(failed) - col(total)) <= slack


# tiers


def severity(gap: Column | str, scale=ROW_SCALE) -> Column:
    """Severity of a gap share, on the scale for rows or the one for rollups, which differ."""
    bounds, rest, unknown = scale
    out = F.when(col(gap).isNull(), unknown)
    for least, beyond, name in bounds:
        out = out.when(col(gap) > least if beyond else col(gap) >= least, name)
    return out.otherwise(rest)


def severity_score(name: Column | str) -> Column:
    scores = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in SEVERITY_SCORES.items()))
    return F.coalesce(scores[col(name)], F.lit(0))


def bins(value: Column | str, edges: Iterable[tuple[float, str]], last: str) -> Column:
    """Right-closed bins: the first name whose edge is not exceeded."""
    out = F.when(col(value).isNull(), F.lit(None).cast("string"))
    for edge, name in edges:
        out = out.when(col(value) <= edge, name)
    return out.otherwise(last)


def risk_tier(p: Column | str) -> Column:
    return bins(p, ((0.2, "LOW"), (0.4, "MEDIUM"), (0.7, "HIGH")), "CRITICAL")


def anomaly_tier(rank: Column | str) -> Column:
    return bins(rank, ((0.02, "CRITICAL"), (0.05, "HIGH"), (0.1, "MEDIUM")), "NORMAL")


def oee_tier(oee: Column | str) -> Column:
    c = col(oee)
    return F.when(c >= 0.85, "WORLD_CLASS").when(c >= 0.65, "GOOD").when(c >= 0.5, "AVERAGE").otherwise("POOR")


def bias(error: Column | str) -> Column:
    return F.when(col(error) > 0, "OVER_FORECAST").when(col(error) < 0, "UNDER_FORECAST").otherwise("ACCURATE")


def variance_flag(change: Column | str) -> Column:
    return F.when(F.abs(col(change)) > 0.05, "SIGNIFICANT").when(F.abs(col(change)) > 0.02, "MODERATE").otherwise("NORMAL")


def lookup(c: Column | str, values: Mapping[str, float], otherwise: float) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))
    return F.coalesce(table[col(c)], F.lit(otherwise))
