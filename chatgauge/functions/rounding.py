"""Decimal rounding of doubles that agrees with correctly rounded ``round(x, d)``.

Spark's ``round``/``bround`` decide ties on the printed decimal (1/160 prints
0.00625 and ``bround`` gives 0.0062) although the stored binary value lies
slightly above it.  ``rint(x * 10^d)`` is right unless the product comes out as
exactly k + 0.5; then the sign of the product's rounding error decides, and it is
found exactly by splitting the double into halves whose products carry no error.
Everything is double arithmetic, so it stays in generated code.

Arguments are column names: the expression repeats them, so give longer ones a
name in an earlier projection.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sql(x: str, digits: int) -> str:
    """Round half to even on the exact binary value; null stays null."""
    scale, split = f"{10**digits}D", "134217729D"  # 2**27 + 1
    product = f"({x} * {scale})"
    high = f"({x} * {split} - ({x} * {split} - {x}))"
    error = f"(({high} * {scale} - {product}) + ({x} - {high}) * {scale})"
    # beyond 2**52 a product has no digits left to round
    return (
        f"CASE WHEN abs({product}) >= 4503599627370496D THEN CAST({x} AS DOUBLE) "
        f"WHEN abs({product} - rint({product})) = 0.5D "
        f"THEN rint({product} + signum({error}) * 0.25D) / {scale} "
        f"ELSE rint({product}) / {scale} END"
    )


def round_exact(x: str, digits: int) -> Column:
    return F.expr(exact_sql(x, digits))


def printed_sql(x: str, digits: int) -> str:
    """Text with that many decimals of a value already rounded to them; any double has one."""
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) THEN 'nan' WHEN abs({x}) = DOUBLE('Infinity') THEN if({x} > 0, 'inf', '-inf') "
        f"ELSE format_string('%.{digits}f', CAST({x} AS DOUBLE)) END"
    )


def ratio_sql(a: str, b: str) -> str:
    """a / b as double, 0 where b is 0."""
    return f"coalesce(try_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 0D)"
