"""SQL text helpers.

Functions of this package take column names or other SQL expressions as text, and
return text (``*_sql``) or a Column.  Text reaches the JVM as one call however long
the expression is.
"""


def literal(value) -> str:
    """A SQL literal of a string, number, bool, None or list of these."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}L"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
        return f"'{escaped}'"
    return "array(" + ", ".join(map(literal, value)) + ")"
