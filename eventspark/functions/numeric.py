"""Rounding, safe division and the two percentile definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bankers(c: Column, scale: int) -> Column:
    """Round half to even."""
    return F.bround(c, scale)


def decimal_half_up(c: Column, scale: int) -> Column:
    """``round(x::numeric, scale)``: the value as a decimal, HALF_UP."""
    return F.round(c.cast("decimal(38,18)"), scale).cast(f"decimal(38,{scale})")


def ratio_half_up(num: Column, den: Column, scale: int) -> Column:
    """``num / den`` rounded HALF_UP to ``scale`` digits, exactly, for integers
    ``num >= 0`` and ``den > 0``: ``(2 * num * 10^s + den) div (2 * den)``.

    Integer arithmetic on DECIMAL(38,0): no intermediate rounding can turn a
    value just below a tie into a tie (as a DOUBLE or a fixed-scale quotient
    can, once groups are large). Numbers that leave room for it are divided as
    BIGINT, which is the same and many times as fast.
    """
    f = 10 ** scale
    d38 = "decimal(38,0)"
    n = num.cast(d38) * F.lit(2 * f).cast(d38) + den.cast(d38)
    d = den.cast(d38) * F.lit(2).cast(d38)
    q = ((n - F.pmod(n, d)) / d).cast(d38)
    any_size = (q / F.lit(f).cast(d38)).cast(f"decimal(38,{scale})")
    most = 2**61 // f
    num64, den64 = num.cast("long"), den.cast("long")
    q64 = F.call_function("div", num64 * F.lit(2 * f) + den64, den64 * F.lit(2))
    fits = (num >= 0) & (num < F.lit(most)) & (den > 0) & (den < F.lit(most))
    return F.when(fits, _of_units(q64, scale)).otherwise(any_size)


def _unit(scale: int, times: int = 1) -> Column:
    return F.lit(times).cast("decimal(1,0)") * F.lit(f"1e-{scale}").cast(f"decimal({scale + 1},{scale})")


def _of_units(count: Column, scale: int) -> Column:
    """A BIGINT of units of 10^-scale as a decimal."""
    return (count.cast("decimal(19,0)") * _unit(scale)).cast(f"decimal(38,{scale})")


def exact_avg_half_up(total: Column, n: Column, scale: int) -> Column:
    """Average of non-negative integers, HALF_UP at ``scale`` (exact)."""
    return ratio_half_up(total, n, scale)


#: Prices below this are summed as they are: 10^11 of them stay within 38 digits.
LARGE_PRICE = 10**9


def price_sums(price: str) -> dict[str, Column]:
    """Three sums that no number of rows overflows: of the prices below
    ``LARGE_PRICE``, and of the whole parts and 10^-18 units of the others."""
    p = F.col(price)
    large = p >= F.lit(LARGE_PRICE).cast("decimal(10,0)")
    whole = F.floor(p).cast("decimal(20,0)")
    units = ((p % F.lit(1).cast("decimal(1,0)")).cast("decimal(18,18)") * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(18,0)")
    return {"price_sum": F.sum(F.when(~large, p)).cast("decimal(38,18)"), "price_whole": F.sum(F.when(large, whole)).cast("decimal(38,0)"),
            "price_units": F.sum(F.when(large, units)).cast("decimal(38,0)")}


def average_of_sums(price_sum: Column, price_whole: Column, price_units: Column, n: Column, scale: int) -> Column:
    """Exact HALF_UP average at ``scale`` (at most 18) from ``price_sums``.

    Up to scale 6, sums below 10^11 of prices that are all below ``LARGE_PRICE``
    take one division, ``(2 * sum + n * 10^-s) div (2 * n * 10^-s)``, in decimals
    that hold every digit of it; the long division of the others is kept out of
    the generated code, where it would take the room of all that is compiled."""
    if scale > 6:
        return _average_of_any_sums(price_sum, price_whole, price_units, n, scale)
    total, count = price_sum.cast("decimal(30,18)"), n.cast("decimal(10,0)")
    units = F.call_function("div", total + total + count * _unit(scale), count * _unit(scale, 2))
    fits = price_whole.isNull() & price_units.isNull() & (price_sum >= 0) & (price_sum < F.lit(10**11)) & (n > 0) & (n < F.lit(10**9))
    sums = F.array(F.struct(price_sum.alias("s"), price_whole.alias("w"), price_units.alias("u"), n.alias("n")))
    any_sums = F.transform(sums, lambda x: _average_of_any_sums(x["s"], x["w"], x["u"], x["n"], scale))
    return F.when(fits, _of_units(units, scale)).otherwise(any_sums[0])


def _average_of_any_sums(price_sum: Column, price_whole: Column, price_units: Column, n: Column, scale: int) -> Column:
    d38, zero = "decimal(38,0)", F.lit(0).cast("decimal(38,0)")
    small = F.coalesce(price_sum, F.lit(0).cast("decimal(38,18)"))
    whole = F.floor(small).cast(d38) + F.coalesce(price_whole.cast(d38), zero)
    units = (((small % F.lit(1).cast("decimal(1,0)")).cast("decimal(18,18)") * F.lit(10**18).cast("decimal(19,0)")).cast(d38)
             + F.coalesce(price_units.cast(d38), zero))
    return average_of_parts(whole, units, n, scale)


def average_of_parts(whole: Column, units: Column, n: Column, scale: int) -> Column:
    """Exact HALF_UP average at ``scale`` (at most 18) of ``n`` prices, given
    the sums of their parts: long division, so nothing passes 38 digits."""
    d38 = "decimal(38,0)"
    w, count = whole.cast(d38), n.cast(d38)
    rest = F.pmod(w, count)
    quotient = ((w - rest) / count).cast(d38)
    below = rest * F.lit(10**18).cast(d38) + units.cast(d38)
    den = (count * F.lit(10 ** (18 - scale)).cast(d38)).cast(d38)
    num = (below.cast(d38) * F.lit(2).cast(d38) + den).cast(d38)
    twice = (den * F.lit(2).cast(d38)).cast(d38)
    fraction = ((num - F.pmod(num, twice)) / twice).cast(d38)
    one = F.lit(10**scale).cast(d38)
    low = F.pmod(fraction, one)  # the units of many prices make up whole ones
    whole_text = (quotient + ((fraction - low) / one).cast(d38)).cast(d38).cast("string")
    digits = F.lpad(low.cast(d38).cast("string"), scale, "0")
    # a sum of decimals this wide would be rounded; their digits are not
    return F.concat(whole_text, F.lit("."), digits).cast(f"decimal(38,{scale})")


def average_price(price: str, scale: int) -> Column:
    """``avg(price)`` of non-negative DECIMAL(38,18), exact, HALF_UP at ``scale``."""
    return average_of_sums(*price_sums(price).values(), F.count(F.col(price)), scale)


def safe_div(a: Column, b: Column) -> Column:
    """``a / nullif(b, 0)``."""
    return a / F.nullif(b, F.lit(0))


def nearest_rank(col_name: str, p: float) -> Column:
    """Nearest-rank percentile: the value at index ``ceil(p*n) - 1`` of the
    sorted group (``percentile_disc``; partial aggregation over value counts)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{col_name}`)")


def interpolated(col_name: str, p: float) -> Column:
    """Linearly interpolated percentile (``percentile_cont``), DOUBLE."""
    return F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY `{col_name}`)")
