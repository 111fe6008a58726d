"""A model's own chat template as a Spark expression.

Covers what published templates of plain chat models use: text, ``{{ expression }}``, one or
more loops over ``messages``, and conditions. Expressions are literals, fields of the loop's
message, ``loop.first``/``loop.last``/``loop.index0``, variables given by the caller (such as
``bos_token`` or ``add_generation_prompt``), ``+``, ``%``, comparisons, ``and``/``or``/``not``
and the filters ``trim``, ``upper`` and ``lower``. Anything else is refused when the template
is compiled, not rendered wrongly. Null content renders as the empty string.
"""

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import literal

BLANKS = "' \\t\\r\\n\\f'"
FILTERS = {"trim": f"btrim({{}}, {BLANKS})", "upper": "upper({})", "lower": "lower({})"}
COMPARISONS = {"==": "<=>", "!=": "<=>", "<": "<", ">": ">", "<=": "<=", ">=": ">="}
TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[][().|+%<>]))""")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    pass


class _Expression:
    """Recursive descent over one expression; a value is (kind, SQL) with kind text, number or truth."""

    def __init__(self, source, message, variables):
        self.source, self.message, self.variables, self.tokens = source, message, variables, []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r} in a template expression")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self, value=None):
        kind, text = self.peek()
        if kind is None or value is not None and text != value:
            raise TemplateError(f"expected {value or 'more'} in {self.source!r}")
        self.at += 1
        return kind, text

    def whole(self):
        made = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()[1]!r} in {self.source!r}")
        return made

    def _chain(self, part, word, sign):
        made = part()
        while self.peek() == ("name", word):
            self.take()
            made = ("truth", f"({self.truth(made)} {sign} {self.truth(part())})")
        return made

    def either(self):
        return self._chain(self.both, "or", "OR")

    def both(self):
        return self._chain(self.negated, "and", "AND")

    def negated(self):
        if self.peek() == ("name", "not"):
            self.take()
            return "truth", f"(NOT {self.truth(self.negated())})"
        return self.compared()

    def compared(self):
        left = self.added()
        kind, sign = self.peek()
        if kind == "sign" and sign in COMPARISONS:
            self.take()
            right = self.added()
            if left[0] != right[0]:
                raise TemplateError(f"{self.source!r} compares {left[0]} with {right[0]}")
            same = f"({left[1]} {COMPARISONS[sign]} {right[1]})"
            return "truth", f"(NOT {same})" if sign == "!=" else same
        return left

    def added(self):
        made = self.filtered()
        while self.peek() in (("sign", "+"), ("sign", "%")):
            sign, right = self.take()[1], self.filtered()
            wanted = "number" if sign == "%" else made[0]
            if made[0] != wanted or right[0] != wanted or wanted == "truth":
                raise TemplateError(f"cannot apply {sign} in {self.source!r}")
            made = (wanted, f"concat({made[1]}, {right[1]})" if wanted == "text" else f"({made[1]} {sign} {right[1]})")
        return made

    def filtered(self):
        made = self.atom()
        while self.peek() == ("sign", "|"):
            self.take()
            name = self.take()[1]
            if name not in FILTERS or made[0] != "text":
                raise TemplateError(f"no filter {name!r} for {made[0]}")
            made = ("text", FILTERS[name].format(made[1]))
        return made

    def atom(self):
        kind, value = self.take()
        if kind == "text":
            return "text", literal(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return "number", value
        if (kind, value) == ("sign", "("):
            made = self.either()
            self.take(")")
            return made
        if kind == "name":
            return self.named(value)
        raise TemplateError(f"unexpected {value!r} in {self.source!r}")

    def field(self):
        if self.take()[1] == ".":
            return self.take()[1]
        kind, name = self.take()
        if kind != "text":
            raise TemplateError(f"only named fields can be read in {self.source!r}")
        self.take("]")
        return name[1:-1]

    def named(self, name):
        if name in ("true", "True", "false", "False"):
            return "truth", name.lower()
        if self.message and name == self.message:
            field = self.field()
            if field not in ("role", "content"):
                raise TemplateError(f"messages have no field {field!r}")
            return "text", f"coalesce(m.{field}, '')"
        if self.message and name == "loop":
            what = self.field()
            known = {"first": ("truth", "(i = 0)"), "last": ("truth", "(i = t.n - 1)"), "index0": ("number", "i")}
            if what not in known:
                raise TemplateError(f"no loop.{what}")
            return known[what]
        if name in self.variables:
            value = self.variables[name]
            return ("truth", str(value).lower()) if isinstance(value, bool) else ("text", literal(str(value)))
        raise TemplateError(f"unknown name {name!r}")

    @staticmethod
    def truth(value):
        kind, sql = value
        return sql if kind == "truth" else f"({sql} <> {'0' if kind == 'number' else literal('')})"


def _pieces(template):
    """(kind, body) in order, kinds text, value and block.

    A dash trims the text beside it. As where such templates are used, the line break behind
    a block goes, and so do the blanks between a line's begin and a block.
    """
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", template, flags=re.S)
    out, before = [], ""
    for k, part in enumerate(parts):
        if k % 2:
            before = part
            if part[1] != "#":
                out.append(("value" if part[1] == "{" else "block", part[2:-2].strip("-").strip()))
            continue
        follows = parts[k + 1] if k + 1 < len(parts) else ""
        if before[-3:-2] == "-":
            part = part.lstrip()
        elif before[1:2] in ("%", "#"):
            part = part.removeprefix("\n")
        if follows[2:3] == "-":
            part = part.rstrip()
        elif follows[1:2] in ("%", "#"):
            begins = not before or before[1] in "%#"
            part = re.sub(r"(\n|\A)[ \t]*\Z" if begins else r"(\n)[ \t]*\Z", r"\1", part)
        if part:
            out.append(("text", part))
    return out


class _Compiler:
    def __init__(self, template, variables):
        self.pieces, self.variables, self.at = _pieces(template), variables, 0

    def value(self, source, message):
        kind, sql = _Expression(source, message, self.variables).whole()
        if kind == "truth":
            raise TemplateError(f"{source!r} is a condition, not a text")
        return sql if kind == "text" else f"CAST({sql} AS STRING)"

    def condition(self, source, message):
        return _Expression.truth(_Expression(source, message, self.variables).whole())

    def block(self, ends, message=None):
        """SQL of the text up to one of the ``ends``, and which it was."""
        out = []
        while self.at < len(self.pieces):
            kind, body = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                out.append(literal(body))
            elif kind == "value":
                out.append(self.value(body, message))
            elif body.split(" ")[0] in ends:
                return self.joined(out), body
            elif body.startswith("for "):
                out.append(self.loop(body, message))
            elif body.startswith("if "):
                out.append(self.choice(body, message))
            else:
                raise TemplateError(f"unknown block {body!r}")
        if ends:
            raise TemplateError(f"a block is not closed by {' or '.join(ends)}")
        return self.joined(out), None

    @staticmethod
    def joined(parts):
        return f"concat({', '.join(parts)})" if parts else "''"

    def loop(self, body, outer):
        m = re.fullmatch(r"for (\w+) in messages", body)
        if not m or outer:
            raise TemplateError(f"only one loop over messages at a time, not {body!r}")
        inner, _ = self.block(["endfor"], m[1])
        return f"array_join(transform(t.ms, (m, i) -> {inner}), '')"

    def choice(self, body, message):
        cases, source = [], body[3:]
        while True:
            inner, end = self.block(["elif", "else", "endif"], message)
            cases.append(f"WHEN {self.condition(source, message)} THEN {inner}")
            if end == "endif":
                return f"CASE {' '.join(cases)} ELSE '' END"
            if end == "else":
                inner, _ = self.block(["endif"], message)
                return f"CASE {' '.join(cases)} ELSE {inner} END"
            source = end[5:]


def template_sql(template: str, messages="messages", **variables) -> str:
    """SQL of the rendered text of an array of (role, content) messages."""
    sql, _ = _Compiler(template, variables).block([])
    # the one-element array names the messages and their number once for the whole template
    return f"element_at(transform(array(struct({messages} AS ms, size({messages}) AS n)), t -> {sql}), 1)"


def render_template(template: str, messages="messages", **variables) -> Column:
    return F.expr(template_sql(template, messages, **variables))


class ChatTemplate(NamedTuple):
    """A template with the values of its variables, for whole chats and for prompts."""

    source: str
    variables: dict = {}

    def chat_sql(self, messages):
        return template_sql(self.source, messages, **{"add_generation_prompt": False} | self.variables)

    def prompt_sql(self, messages):
        return template_sql(self.source, messages, **{"add_generation_prompt": True} | self.variables)
