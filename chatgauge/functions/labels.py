"""Class labels found in free text by whole-word search.

Longer class names win over shorter ones, ties go by the given order, and a text
naming no class gets the first one.  A word character is a letter, a number or
``_`` of any script, stated as a character class because the engines' own ``\\b``
differ outside ASCII.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import literal

# The name is searched first and its surroundings are looked at only where it occurs.
# U+10400 is a letter and so changes nothing in the first class, but with a character
# beyond 16 bits in it Java looks back by whole characters, not by halves of a pair.
BEHIND = ("(?<=(?:^|[^\\p{L}\\p{N}_\U00010400])\\Q", "\\E)")
AFTER = "(?:$|[^\\p{L}\\p{N}_])"


def clean_classes(classes) -> tuple:
    """Upper-cased class names; rejects names the whole-word rule cannot carry."""
    names = tuple(str(c).upper() for c in classes)
    if not names:
        raise ValueError("at least one class is needed")
    for name in names:
        if not re.fullmatch(r"\w(.*\w)?", name, re.S) or "\\E" in name:
            raise ValueError(f"class name must begin and end with a word character: {name!r}")
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate class names: {names}")
    return names


def search_order(classes) -> list:
    """Classes by falling length, given order kept on ties."""
    return sorted(clean_classes(classes), key=len, reverse=True)


def names_class_sql(upper_text: str, name: str) -> str:
    """Whether the upper-cased text holds ``name`` as a whole word."""
    # the byte search is far cheaper than the pattern and rules out most texts
    pattern = f"\\Q{name}\\E{BEHIND[0]}{name}{BEHIND[1]}{AFTER}"
    return f"(contains({upper_text}, {literal(name)}) AND {upper_text} RLIKE {literal(pattern)})"


def label_sql(text: str, classes) -> str:
    """Label of each text for a fixed class list; null text gives null."""
    names = clean_classes(classes)
    tests = " ".join(f"WHEN {names_class_sql('u', name)} THEN {literal(name)}" for name in search_order(names))
    # the one-element array gives the upper-cased text a name, so it is made once per row
    found = f"element_at(transform(array(upper({text})), u -> CASE {tests} ELSE {literal(names[0])} END), 1)"
    return f"CASE WHEN {text} IS NOT NULL THEN {found} END"


def extract_label(text: str, classes) -> Column:
    return F.expr(label_sql(text, classes))


def extract_label_by_row(text: str, classes: str) -> Column:
    """Label of each text where every row brings its own class list."""
    pattern = f"concat('\\\\Q', c, '\\\\E', {literal(BEHIND[0])}, c, {literal(BEHIND[1] + AFTER)})"
    ordered = f"array_sort(transform({classes}, c -> upper(c)), (a, b) -> length(b) - length(a))"
    hit = f"try_element_at(filter({ordered}, c -> contains(u, c) AND u RLIKE {pattern}), 1)"
    # the one-element array gives the upper-cased text a name, so it is made once per row
    hits = f"element_at(transform(array(upper({text})), u -> {hit}), 1)"
    return F.expr(f"CASE WHEN {text} IS NOT NULL THEN coalesce({hits}, upper(try_element_at({classes}, 1))) END")


def task_label_sql(text: str, task: str, specs) -> str:
    """Label of each text by the class list of its task.

    The lists are known when the plan is built, so every pattern is a literal that
    is compiled once; tasks sharing a list share one branch.
    """
    by_list = {}
    for spec in specs:
        by_list.setdefault(spec.classes, []).append(literal(spec.task))
    branches = " ".join(
        f"WHEN {task} IN ({', '.join(tasks)}) THEN {label_sql(text, classes)}" for classes, tasks in by_list.items()
    )
    return f"CASE {branches} END"


def extract_label_by_task(text: str, task: str, specs) -> Column:
    return F.expr(task_label_sql(text, task, specs))
