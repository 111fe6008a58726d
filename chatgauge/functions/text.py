"""Text helpers: value-to-text conversion, truthiness and token truncation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = "[ \\\\t\\\\r\\\\n]+"  # as a SQL literal
BLANK_CHARS = "' \\t\\r\\n'"

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)
_FLOATS = (T.FloatType, T.DoubleType)


def float_text_sql(x: str) -> str:
    """Shortest text of a double: plain from 1e-4 up to 1e16, else ``1e-05`` style.

    Spark writes doubles plainly from 1e-3 up to 1e7 only; the other forms are rare.
    """
    java = f"CAST({x} AS STRING)"
    power = f"CAST(substring_index({java}, 'E', -1) AS INT)"
    plain = f"regexp_replace(CAST(CAST({x} AS DECIMAL(38,21)) AS STRING), '(\\\\.[0-9]+?)0+$', '$1')"
    scientific = (
        f"concat(regexp_replace(substring_index({java}, 'E', 1), '\\\\.0$', ''), "
        f"if({power} < 0, 'e-', 'e+'), lpad(abs({power}), greatest(2, length(abs({power}))), '0'))"
    )
    return (
        f"CASE WHEN {x} = 0D OR (abs({x}) >= 1e-3D AND abs({x}) < 1e7D) THEN {java} "
        f"WHEN isnan({x}) THEN 'nan' WHEN abs({x}) = DOUBLE('Infinity') THEN if({x} > 0, 'inf', '-inf') "
        f"WHEN abs({x}) >= 1e-4D AND abs({x}) < 1e16D THEN {plain} ELSE {scientific} END"
    )


def plain_text_sql(x: str, dtype: T.DataType) -> str:
    """Text of a typed column the way the converters print values; null prints None."""
    if isinstance(dtype, T.NullType):
        return "'None'"
    if isinstance(dtype, T.StringType):
        text = x
    elif isinstance(dtype, T.BooleanType):
        text = f"if({x}, 'True', 'False')"
    elif isinstance(dtype, _WHOLE):
        text = f"CAST({x} AS STRING)"
    elif isinstance(dtype, _FLOATS):
        text = float_text_sql(x)
    else:
        raise TypeError(f"cannot print values of type {dtype.simpleString()} in a message")
    return f"CASE WHEN {x} IS NULL THEN 'None' ELSE {text} END"


def is_filled_sql(x: str, dtype: T.DataType) -> str:
    """False for null, empty text, zero and false; true otherwise."""
    if isinstance(dtype, T.NullType):
        return "false"
    if isinstance(dtype, T.StringType):
        filled = f"{x} <> ''"
    elif isinstance(dtype, T.BooleanType):
        filled = x
    else:
        filled = f"{x} <> 0"
    return f"coalesce({filled}, false)"


def _rest_sql(text: str, n: int) -> str:
    """What follows the n-th token, empty where nothing does.

    n + 1 tokens and the blanks between them take at least 2n + 1 bytes, so shorter
    texts need no splitting.
    """
    after = f"try_element_at(split(ltrim({BLANK_CHARS}, {text}), '{BLANKS}', {n + 1}), {n + 1})"
    return f"if(octet_length({text}) <= {2 * n}, '', coalesce({after}, ''))"


def _head_sql(text: str, rest: str) -> str:
    return f"if({rest} = '', {text}, rtrim({BLANK_CHARS}, left({text}, length({text}) - length({rest}))))"


def truncate_sql(text: str, n: int) -> str:
    """The text up to the end of its n-th blank-separated token, spacing kept.

    ``split`` stops after n pieces, so the tail of a long text is never cut up.
    """
    return _head_sql(text, _rest_sql(text, n))


def truncated(df: DataFrame, column: str, n: int, flag=None) -> DataFrame:
    """Truncate a column of a table; ``flag`` names a column that says whether it was cut.

    Each text is split only once.
    """
    staged = df.selectExpr("*", f"{_rest_sql(column, n)} AS _rest")
    cut = [f"{_head_sql(c, '_rest')} AS {c}" if c == column else f"`{c}`" for c in df.columns]
    return staged.selectExpr(*cut, *([f"_rest <> '' AS {flag}"] if flag else []))


def truncate_tokens(text: str, n: int) -> Column:
    return F.expr(truncate_sql(text, n))


def is_truncated(text: str, n: int) -> Column:
    """Whether the text holds more than n tokens."""
    return F.expr(f"{_rest_sql(text, n)} <> ''")
