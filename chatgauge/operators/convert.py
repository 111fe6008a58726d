"""Five example layouts to one messages column.

Precedence: messages, CVE, instruction, question/answer, prompt/completion.  What
counts is the presence of a key, not its value.  A table whose columns are the keys
is decided when the plan is built; rows of differing layouts come as one JSON text
per row and are decided per row on VARIANT values.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import literal
from ..functions.text import float_text_sql, is_filled_sql, plain_text_sql
from ..schema import CVE_SYSTEM, CVE_UNRATED, HELPER_SYSTEM, MESSAGES

# keys that decide a layout: all of one of the groups must be present
RULES = {
    "messages": [["messages"]],
    "cve": [["description"], ["cve_id"]],
    "instruction": [["instruction", "output"]],
    "qa": [["question", "answer"]],
    "prompt": [["prompt", "completion"]],
}

# keys that fill the parts of a chat, the first one present counting
PARTS = {
    "cve": {"id": ["cve_id"], "ask": ["description", "text"], "answer": ["severity", "label"]},
    "instruction": {"ask": ["instruction"], "extra": ["input"], "answer": ["output"]},
    "qa": {"ask": ["question"], "answer": ["answer"]},
    "prompt": {"ask": ["prompt"], "answer": ["completion"]},
}
NAMES = ("id", "ask", "extra", "answer")


def _chat_sql(system, user, answer):
    turns = [("system", literal(system)), ("user", user), ("assistant", answer)]
    return "array(" + ", ".join(f"named_struct('role', '{r}', 'content', {c})" for r, c in turns) + ")"


def chat_from_parts_sql(layout) -> str:
    """Messages from the part columns: _text (null if absent), _filled and _none of each part."""
    if layout == "cve":
        # fixed value: the wording of the question
        user = (
            "concat('Analyze this CVE:\\n\\nCVE ID: ', coalesce(_id_text, 'Unknown'), "
            "'\\nDescription: ', coalesce(_ask_text, ''))"
        )
        return _chat_sql(CVE_SYSTEM, user, f"if(_answer_filled, _answer_text, {literal(CVE_UNRATED)})")
    user = "_ask_text"
    if layout == "instruction":
        # a null instruction has no text to extend and stays null
        user = "if(_ask_none, NULL, concat(_ask_text, if(_extra_filled, concat('\\n\\n', _extra_text), '')))"
    return _chat_sql(HELPER_SYSTEM, user, "_answer_text")


def _part(name, text="CAST(NULL AS STRING)", filled="false", none="false"):
    """The three columns of a part.

    Flat columns rather than a struct: the optimizer merges projections that only
    take structs apart again, and would then repeat their long expressions.
    """
    return [f"{text} AS _{name}_text", f"{filled} AS _{name}_filled", f"{none} AS _{name}_none"]


def table_layout(columns):
    """Layout of a table whose columns are the example's keys, or None."""
    for layout, groups in RULES.items():
        if any(all(key in columns for key in group) for group in groups):
            return layout
    return None


def _from_table(df: DataFrame, layout) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}

    def part(name):
        for key in PARTS[layout].get(name, []):
            if key in types:
                column, kind = f"`{key}`", types[key]
                return _part(name, plain_text_sql(column, kind), is_filled_sql(column, kind), f"{column} IS NULL")
        return _part(name)

    kept = [f"`{c}`" for c in df.columns if c != "messages"]
    rows = df.selectExpr(*kept, *[column for name in NAMES for column in part(name)])
    return rows.selectExpr(*kept, f"CAST({chat_from_parts_sql(layout)} AS {MESSAGES.simpleString()}) AS messages")


def _printed(name):
    kind, text, number = f"_{name}_kind", f"_{name}_text", f"_{name}_number"
    # a whole number too long for BIGINT and a short one written with a zero
    # fraction both arrive as DECIMAL without a fraction; the length tells them apart
    long_whole = f"({kind} LIKE 'DECIMAL(%,0)' AND length({text}) > 18)"
    printed = (
        f"CASE WHEN {kind} IS NULL OR {kind} IN ('STRING', 'BIGINT') OR {long_whole} THEN {text} "
        f"WHEN {kind} = 'VOID' THEN 'None' WHEN {kind} = 'BOOLEAN' THEN initcap({text}) "
        f"WHEN {kind} LIKE 'DECIMAL%' OR {kind} = 'DOUBLE' THEN {float_text_sql(number)} "
        f"ELSE raise_error(concat('cannot print a value of type ', {kind}, ' in a message')) END"
    )
    filled = (
        f"coalesce(CASE {kind} WHEN 'STRING' THEN {text} <> '' WHEN 'BOOLEAN' THEN {text} = 'true' "
        f"WHEN 'VOID' THEN false ELSE {number} <> 0 END, false)"
    )
    return _part(name, printed, filled, f"coalesce({kind} = 'VOID', false)")


def _from_json(df: DataFrame, raw, drop_unknown) -> DataFrame:
    """Each step is a projection of its own, so that a row is parsed only once.

    The last step is a generator: a filter on ``messages``, ours or a later one, would
    be pushed below the projections with all their expressions put into it.
    """
    kept = [f"`{c}`" for c in df.columns if c != "messages"]
    parsed = df.selectExpr(*kept, f"parse_json({raw}) AS _v")
    opened = parsed.selectExpr(*kept, "_v", "try_variant_get(_v, '$', 'map<string,variant>') AS _m")

    def present(key):
        return f"coalesce(map_contains_key(_m, '{key}'), false)"

    tests = " ".join(
        "WHEN " + " OR ".join("(" + " AND ".join(map(present, group)) + ")" for group in groups) + f" THEN '{layout}'"
        for layout, groups in RULES.items()
    )
    layouts = opened.selectExpr(*kept, "_v", "_m", f"CASE WHEN _m IS NULL THEN 'list' {tests} END AS _layout")

    def value(name):
        cases = []
        for layout, keys in PARTS.items():
            if name in keys:
                first = " ".join(f"WHEN {present(key)} THEN _m['{key}']" for key in keys[name])
                cases.append(f"WHEN '{layout}' THEN CASE {first} END")
        return f"CASE _layout {' '.join(cases)} END AS _{name}"

    values = layouts.selectExpr(*kept, "_v", "_layout", *map(value, NAMES))
    typed = [
        column for n in NAMES for column in (
            f"schema_of_variant(_{n}) AS _{n}_kind", f"CAST(_{n} AS STRING) AS _{n}_text", f"TRY_CAST(_{n} AS DOUBLE) AS _{n}_number",
        )
    ]
    printed = values.selectExpr(*kept, "_v", "_layout", *typed).selectExpr(
        *kept, "_v", "_layout", *[column for name in NAMES for column in _printed(name)]
    )
    shape = MESSAGES.simpleString()
    built = " ".join(f"WHEN '{layout}' THEN {chat_from_parts_sql(layout)}" for layout in PARTS)
    rows = printed.selectExpr(
        *kept,
        f"CASE _layout WHEN 'list' THEN variant_get(_v, '$', '{shape}') "
        f"WHEN 'messages' THEN variant_get(_v, '$.messages', '{shape}') {built} END AS messages",
    )
    keep = "if(size(messages) > 0, array(messages), array())" if drop_unknown else "array(messages)"
    return rows.selectExpr(*kept, f"explode({keep}) AS messages")


def to_messages(df: DataFrame, layout="auto", drop_unknown=True, raw="raw") -> DataFrame:
    """Add ``messages``; rows of no known layout, or with no message, go unless kept.

    ``layout`` is a key of RULES, ``json`` (one JSON text per row in column ``raw``:
    ``{"messages": [...]}``, a bare list of messages, or another layout), or ``auto``:
    the table's columns decide, and a lone JSON column means ``json``.
    """
    if layout == "auto":
        layout = table_layout(df.columns) or ("json" if raw in df.columns else None)
    if layout == "json":
        return _from_json(df, raw, drop_unknown)
    if layout not in (None, "messages"):
        return _from_table(df, layout)
    out = df if layout else df.withColumn("messages", F.lit(None).cast(MESSAGES))
    return out.where("size(messages) > 0") if drop_unknown else out
