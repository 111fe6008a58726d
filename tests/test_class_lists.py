"""Long class lists: the automaton against plain search and against the pattern form."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatgauge.functions.automaton import Automaton, word_bytes
from chatgauge.functions.labels import extract_label, extract_label_by_row
from chatgauge.operators.class_lists import automaton, with_label


def arrays(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def occurrences(names, texts):
    """Every place of every name, by plain search."""
    out, base = set(), 0
    for i, t in enumerate(t.encode() for t in texts):
        for k, name in enumerate(n.encode() for n in names):
            at = t.find(name)
            while at >= 0:
                out.add((i, k, base + at, base + at + len(name)))
                at = t.find(name, at + 1)
        base += len(t)
    return out


letters = st.text("abé漢", min_size=1, max_size=4)


@settings(max_examples=200, deadline=None)
@given(st.lists(letters, min_size=1, max_size=12, unique=True), st.lists(st.text("abcé漢 ", max_size=30), max_size=6))
def test_hits_equal_plain_search(names, texts):
    found = list(zip(*(c.tolist() for c in Automaton([n.encode() for n in names]).hits(*arrays(texts)))))
    assert len(found) == len(set(found)) and set(found) == occurrences(names, texts)


def test_windows_lose_no_hit(monkeypatch):
    rng = random.Random(1)
    names = ["".join(rng.choices("ab", k=n)) for n in (1, 2, 5, 9, 20)]
    texts = ["", "".join(rng.choices("ab", k=700)), "a", "".join(rng.choices("ab ", k=333))]
    for window in (3, 16, 100):
        monkeypatch.setattr("chatgauge.functions.automaton.WINDOW", window)
        found = list(zip(*(c.tolist() for c in Automaton([n.encode() for n in names]).hits(*arrays(texts)))))
        assert len(found) == len(set(found)) and set(found) == occurrences(names, texts)


def test_word_bytes_are_letters_numbers_and_underscores():
    text = "aZ_9 -é漢\U00010400😀Ⅷ٣́!"
    data, _ = arrays([text])
    want = [c == "_" or bool(re.match(r"[^\W_]", c)) for c in text for _ in c.encode()]
    assert word_bytes(data).tolist() == want


TEXTS = [
    None, "", "no name", "alpha", "ALPHA_X alpha1 1alpha", "beta, alpha!", "alphabet beta", "x alpha beta gamma delta y", "straße", "ÉTÉ été",
    "éalpha alphaé", "Ⅷalpha", "alpha\U00010400 \U00010400alpha", "😀alpha😀", "a b", "two words", "two  words", "two words more", "alpha " * 3000,
]
LISTS = [["alpha", "beta"], ["beta", "alpha", "alphabet"], ["ÉTÉ", "strasse", "b"], ["two", "two words", "words"], ["z9", "a", "é_1"]]


@pytest.mark.parametrize("classes", LISTS)
def test_labels_equal_the_pattern_forms(spark, classes):
    rows = spark.createDataFrame([(i, t, "x", classes) for i, t in enumerate(TEXTS)], "id long, text string, label2 string, classes array<string>")
    made = with_label(rows.repartition(3), "text", classes).select(
        "id", "label", extract_label("text", classes).alias("fixed"), extract_label_by_row("text", "classes").alias("by_row")
    ).collect()
    assert len(made) == len(TEXTS)
    for r in made:
        assert r["label"] == r["fixed"] == r["by_row"], TEXTS[r["id"]]


def test_ten_thousand_classes(spark):
    rng = random.Random(5)
    classes = sorted({"".join(rng.choices("abcdefgh", k=rng.randint(4, 9))) for _ in range(10_500)})[:10_000]
    rng.shuffle(classes)
    texts = [" ".join(rng.choices(classes, k=5)) if i % 3 else "".join(rng.choices("abcdefgh", k=50)) for i in range(300)]
    machine, order = automaton(classes)
    assert machine.nbytes < 4 << 20 and len(order) == 10_000
    rank = {name: k for k, name in enumerate(order)}
    got = {r["text"]: r["label"] for r in with_label(spark.createDataFrame([(t,) for t in texts], "text string"), "text", classes).collect()}
    for t in texts:
        names = [w for w in t.upper().split() if w in rank]
        assert got[t] == (min(names, key=rank.get) if names else classes[0].upper())


def test_an_automaton_too_large_is_refused(spark):
    with pytest.raises(ValueError, match="bytes"):
        with_label(spark.createDataFrame([("a",)], "text string"), "text", ["alpha", "beta"], most_bytes=10)
