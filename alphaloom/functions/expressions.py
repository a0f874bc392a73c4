"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def normal_date(value: Column | str) -> Column:
    """``yyyyMMdd`` of a date, timestamp, integer or text; null if it is no calendar date.

    A trailing ``.0`` of an integer text, dashes and slashes are dropped; eight
    leading digits are taken as the date, other texts are parsed as timestamps.
    """
    text = F.trim(F.col(value).cast("string") if isinstance(value, str) else value.cast("string"))
    bare = F.regexp_replace(F.regexp_replace(text, r"^([0-9]+)\.0$", "$1"), "[-/]", "")
    digits = F.when(bare.rlike("^[0-9]{8}"), bare.substr(1, 8))
    parsed = F.date_format(F.try_to_timestamp(text), "yyyyMMdd")
    candidate = F.coalesce(digits, parsed)
    return F.when(F.try_to_date(candidate, "yyyyMMdd").isNotNull(), candidate)


def normal_ticker(value: Column | str) -> Column:
    """Trimmed text; integral floats become integer text, blanks become null."""
    column = F.col(value) if isinstance(value, str) else value
    text = F.regexp_replace(F.trim(column.cast("string")), r"^(-?[0-9]+)\.0$", "$1")
    return F.when(text != "", text)


def finite(value: Column | str) -> Column:
    """The number as a double, null unless it is one and finite."""
    column = F.col(value) if isinstance(value, str) else value
    number = column.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def truth(value: Column | str) -> Column:
    """Boolean of true/1/yes/y and false/0/no/n in any case; null for anything else."""
    column = F.col(value) if isinstance(value, str) else value
    text = F.lower(F.trim(column.cast("string")))
    return F.when(text.isin("true", "1", "yes", "y"), True).when(text.isin("false", "0", "no", "n"), False)


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1 in rising order within ``by``; ties share the mean of their ranks."""
    order = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2


def weighted_mean(value: Column, weight: Column, over: WindowSpec) -> Column:
    return F.sum(value * weight).over(over) / F.sum(weight).over(over)


def clipped(value: str, median: str, mad: str, multiple: float) -> Column:
    """``value`` kept within ``multiple`` scaled MADs of the median; unchanged where the MAD is zero or missing."""
    reach = F.lit(multiple * MAD_SCALE) * F.col(mad)
    return F.when(F.col(mad) > 0, F.greatest(F.least(F.col(value), F.col(median) + reach), F.col(median) - reach)).otherwise(F.col(value))


#: Coefficients of Wichura's algorithm AS241 (PPND16), lowest power first.
_CENTRE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
_MIDDLE = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9),
)
_TAIL = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 0.000786869131145613259100, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(pair: tuple, x: str) -> str:
    def number(c: float) -> str:
        return repr(c).upper() if "e" in repr(c) else f"{c!r}E0"

    def horner(coefficients: tuple) -> str:
        text = number(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            text = f"(({text}) * ({x}) + {number(c)})"
        return text

    return f"({horner(pair[0])} / {horner(pair[1])})"


def inverse_normal_sql(p: str) -> str:
    """SQL text of the standard normal quantile at ``p`` (0 < p < 1), the same for Spark and other engines."""
    q = f"({p} - 0.5E0)"
    r = f"(sqrt(-ln(least({p}, 1E0 - {p}))))"
    return (
        f"(CASE WHEN abs({q}) <= 0.425E0 THEN {q} * {_ratio(_CENTRE, f'0.180625E0 - {q} * {q}')} "
        f"ELSE sign({q}) * (CASE WHEN {r} <= 5E0 THEN {_ratio(_MIDDLE, f'{r} - 1.6E0')} ELSE {_ratio(_TAIL, f'{r} - 5E0')} END) END)"
    )
