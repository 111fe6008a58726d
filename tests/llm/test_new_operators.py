"""Fill-in-the-middle, secret scans and hard negatives against brute force, with awkward rows."""

import hashlib
import math
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatgauge.llm import grammar, middle, multi_index
from chatgauge.llm.common import steps

TEXTS = [
    "plain words here", None, "", " ", "one", "ünïcödé ßtraße 漢字 😀 end", "a\nb\n\nc", "\n", "has <P> inside", "<M>", "<S><P>",
    "x" * 70, "word " * 4000, "😀" * 65, "tail break\n", "\ttabs\tand  blanks ", "nul\x00byte", "< P >", "<", ">",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, k % 3, "x") for k, t in enumerate(TEXTS * 6)] + [(4, TEXTS[4], 1, "x"), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, form string").repartition(3)


def cut_by_hand(doc_id, text, ends):
    """(form, k1, k2, prefix, middle, suffix) of a text whose unit ends (the 0th included) are ``ends``."""
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % len(ends), h[1] % len(ends)))
    plain = not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
    form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
    return form, a, b, text[: ends[a]], text[ends[a] : ends[b]], text[ends[b] :]


def unit_ends(text, unit):
    text = text or ""
    if unit == "character":
        return list(range(len(text) + 1))
    if unit == "line":
        ends = [m.end() for m in re.finditer("\n", text)]
        return [0, *ends] + ([len(text)] if text and not text.endswith("\n") else [])
    starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    return [0, *starts[1:]] + ([len(text)] if starts else [])


def output_by_hand(form, prefix, inner, suffix):
    if form == "plain":
        return prefix + inner + suffix
    return f"<P>{prefix}<S>{suffix}<M>{inner}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{inner}"


@pytest.mark.parametrize("unit", ["character", "word", "line"])
def test_middle_equals_slicing(docs, unit):
    got = {(r["doc_id"], r["output"]): r for r in middle.fill_in_middle(docs, unit).collect()}
    seen = set()
    for doc_id, text in {(r["doc_id"], r["text"]) for r in docs.collect()}:
        ends = unit_ends(text, unit)
        form, a, b, prefix, inner, suffix = cut_by_hand(doc_id, text, ends)
        row = got[doc_id, output_by_hand(form, prefix, inner, suffix)]
        seen.add(form)
        assert (row["form"], row["n"]) == (form, len(ends) - 1)
        if form == "plain":
            assert row["prefix_chars"] is row["middle_chars"] is row["prefix_units"] is None
        else:
            assert (row["prefix_units"], row["middle_units"]) == (a, b - a)
            assert (row["prefix_chars"], row["middle_chars"]) == (len(prefix), len(inner))
    assert seen == {"plain", "psm", "spm"}


def test_middle_digests_round_trip(docs):
    made = middle.fill_in_middle_digests(docs)
    assert made.count() == docs.count()
    expected = {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect()}
    assert {(r["doc_id"], r["restored_sha256"]) for r in made.collect()} == expected
    whole = {(r["doc_id"], hashlib.sha256(r["output"].encode()).hexdigest()) for r in middle.fill_in_middle(docs).collect()}
    assert {(r["doc_id"], r["output_sha256"]) for r in made.collect()} == whole
    assert middle.fill_in_middle_digests(docs.limit(0)).collect() == []
    empty = docs.where("text = ''")
    assert {(r["form"], r["n"]) for r in middle.fill_in_middle(empty, "word").collect()} == {("plain", 0)}


@pytest.mark.parametrize("unit", ["character", "word", "line"])
@pytest.mark.parametrize("last", ["", "b", "b c", "b\n"])
def test_middle_last_text_found_before_the_others(unit, last):
    """The last text's end is found while others are still searched, in runs that fill a rank block and in others."""
    for n in (1, 31, 62, 63, 64, 65, 127, 128, 191):
        texts = [("a b\n" * 50)[: max(0, n - len(last))], last]
        for k in range(4):
            h = np.array([[7 * n + k, 11 * n, 0, 99], [k, k + 1, 0, 99]])
            made = dict(zip(middle.NAMES, middle.transformed(pa.array(texts), h, unit)))
            for i, text in enumerate(texts):
                ends = unit_ends(text, unit)
                a, b = sorted(int(x) % len(ends) for x in h[i, :2])
                expected = output_by_hand("psm" if text else "plain", text[: ends[a]], text[ends[a] : ends[b]], text[ends[b] :])
                assert (made["n"][i].as_py(), made["output"][i].as_py()) == (len(ends) - 1, expected.encode())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=400), st.data())
def test_ranks_count_symbols(symbols, data):
    matrix = middle.WaveletMatrix(np.array(symbols, np.uint8))
    at = np.array(data.draw(st.lists(st.integers(0, len(symbols)), min_size=1, max_size=9)), np.int64)
    for s in range(8):
        assert matrix.rank(s, at).tolist() == [symbols[:i].count(s) for i in at]


# ---------------------------------------------------------------- secrets

ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_by_hand(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(grammar.KINDS[k], a, b) for a, k, b in sorted(found)]


AWKWARD = [
    None, "", "é secret=token: abcdefgh", "token=token=abcdefgh", 'API_KEY": "Zz0+/_.=-99', "apikey :  'short'", "passwd=12345",
    "ſecret=abcdefgh toKen=abcdefgh", "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 16 + "ü", "0" * 23, "0" * 24, "dead" * 6 + "g" + "beef" * 6,
    "token = \"" + "0f" * 20 + "\" and AKIA" + "Z9" * 8, "password=password=abc", "tokentoken=......", "a" * 5000, "=" * 300 + "token==" * 50,
    "ß" * 40 + " secret:" + " " * 50 + "x1x1x1", "TOKEN=" + "k" * 20_000,
]


def test_base_spans_equal_patterns(spark):
    rows = [(k, t, "clash") for k, t in enumerate(AWKWARD)] + [(2, AWKWARD[2], ""), (None, AWKWARD[4], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(2)
    found = [(r["doc_id"], [(s["kind"], s["start"], s["stop"]) for s in r["spans"]]) for r in grammar.secrets(docs).collect()]
    expected = [(i, base_by_hand(t)) for i, t, _ in rows]
    assert sorted(found, key=str) == sorted(expected, key=str)  # too few labelled strings: nothing is added
    assert grammar.secrets(docs.limit(0)).collect() == []


def drawn(rng, prefix, letters, n):
    return prefix + "".join(rng.choices(letters, k=n))


@pytest.fixture(scope="module")
def planted(spark):
    """Texts with credentials at keywords, and the same formats (and other long tokens) standing alone."""
    rng = random.Random(3)
    words = ["th", "in", "er", "an", "re", "on", "ti", "le", "que"]
    key = lambda: drawn(rng, "ghp_", string.ascii_letters + string.digits, 36)
    rows, bare, k = [], {}, 0

    def add(*pieces):
        nonlocal k
        prose = ["".join(rng.choices(words, k=rng.randint(5, 9))) for _ in range(6)]
        rows.append((k, " ".join([*prose[:3], *pieces, *prose[3:]])))
        k += 1

    for _ in range(150):
        add(f'token = "{key()}"')
        add(f"api_key: {drawn(rng, '', '0123456789abcdef', 40)}")
    for _ in range(30):
        secret = key()
        bare[k] = secret
        add(secret)
    for _ in range(100):
        add(drawn(rng, "", string.digits, 16), ".".join(str(rng.randint(100, 255)) for _ in range(4)), drawn(rng, "", string.ascii_uppercase, 14))
        add(drawn(rng, "", string.ascii_letters + string.digits, 40))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bare


def test_formats_seen_at_keywords_are_found_alone(planted):
    docs, bare = planted
    found = {}
    for r in grammar.secrets(docs).join(docs, "doc_id").collect():
        for s in r["spans"]:
            if s["kind"] == grammar.ADDED:
                found[r["doc_id"]] = r["text"][s["start"] : s["stop"]]
    assert set(found.items()) <= set(bare.items())  # no clean token is taken
    assert len(found) >= 0.9 * len(bare)


def test_learning_sample_and_counts(planted):
    docs, _ = planted
    strings, counts = grammar.labelled_strings(docs, sample=50)
    assert {k: len(v) for k, v in strings.items()} == {"": 50, "assign": 50, "access": 0, "hex": 50}
    assert counts["assign"] == 300 and counts["hex"] == 150
    ordinary = 0
    for r in docs.collect():
        covered = [(a, b) for _, a, b in base_by_hand(r["text"])]
        for m in re.finditer("[A-Za-z0-9+/_.=-]+", r["text"]):
            body = m[0].strip("+/_.=-")
            ordinary += len(body) >= grammar.SHORTEST and not any(a < m.end() and m.start() < b for a, b in covered)
    assert counts[""] == ordinary


def walked(automaton, s):
    """The likelihood of one string, a symbol at a time."""
    state, total = 0, 0.0
    for d, c in enumerate([*grammar.SYMBOL[np.frombuffer(s, np.uint8)], grammar.END]):
        weights = automaton.levels[d][0][state] if d < grammar.LEVELS else automaton.tail
        total += weights[c]
        if c < grammar.END and d < grammar.LEVELS:
            state = automaton.levels[d][1][state, c]
    return total


@pytest.mark.parametrize("weigh", [grammar.strict, grammar.smoothed])
def test_likelihoods_equal_a_walk_and_sum_to_one(weigh):
    rng = random.Random(8)
    strings = sorted({drawn(rng, "k-", "abcXY01", rng.randint(10, 90)).encode() for _ in range(300)})
    automaton = grammar.infer(strings, weigh)
    asked = strings[:40] + [s[:-3] + b"ZZ=" for s in strings[:20]] + [b"other/thing.here", b"k-" + b"a" * 300]
    assert np.allclose(automaton.likelihood(*grammar.packed(asked)), [walked(automaton, s) for s in asked])
    for weights, _ in automaton.levels:
        shares = np.exp(weights[:-1]).sum(1)
        assert np.allclose(shares, 1)


def test_states_merge_only_where_shares_agree():
    rng = random.Random(2)
    hexes = [drawn(rng, "", "0123456789abcdef", 30).encode() for _ in range(400)]
    mixed = [drawn(rng, "zz_", string.ascii_uppercase, 27).encode() for _ in range(400)]
    automaton = grammar.infer(sorted(set(hexes + mixed)))
    # one state for each format at every depth between, and that for strings that left
    assert {len(w) for w, _ in automaton.levels[3:29]} == {3}
    plain = grammar.infer(sorted(set(hexes)))
    assert {len(w) for w, _ in plain.levels[:30]} == {2}
    cross = [drawn(rng, "zz_", "0123456789abcdef", 27).encode(), drawn(rng, "", "0123456789abcdef", 29).encode()]
    assert np.isneginf(automaton.likelihood(*grammar.packed(cross))).all()


def test_candidates_are_trimmed_runs():
    text = '..--abcdefghijkl==.x  /path/to/some.thing... short "=quoted_value_here==="'
    for _, _, data, offsets in steps(pa.array([text])):
        start, end, _ = grammar.candidates(data, offsets, [])
        assert [text[a:b] for a, b in zip(start, end)] == ["abcdefghijkl==.x", "path/to/some.thing", "quoted_value_here=="]
        start, end, _ = grammar.candidates(data, offsets, [(0, 0, 0, 5, 0)])
        assert [text[a:b] for a, b in zip(start, end)] == ["path/to/some.thing", "quoted_value_here=="]


# ---------------------------------------------------------------- hard negatives


def negatives_by_hand(rows):
    clean = {}
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        row = (label, [math.floor(256 * x) for x in v])
        clean[vec_id] = min(clean.get(vec_id, row), row)
    score = lambda a, b: sum(x * y for x, y in zip(clean[a][1], clean[b][1]))
    out = set()
    for a in (i for i in clean if i % 50 == 0):
        near = sorted((-score(a, i), i) for i in clean if i != a and clean[i][0] == clean[a][0])[:5]
        far = sorted((-score(a, i), i) for i in clean if clean[i][0] != clean[a][0])
        for p, positive in near:
            inside = [(s, i) for s, i in far if 50 * -p <= 100 * -s <= 95 * -p][:3]
            out |= {(a, positive, k + 1, i, -p, -s) for k, (s, i) in enumerate(inside)}
    return out


def vectors(seed, n, dims=6, same=0):
    rng = random.Random(seed)
    out = [(i, rng.randrange(10), [rng.gauss(0, 0.4) for _ in range(dims)]) for i in range(n)]
    out = [(i, c, out[0][2]) if rng.random() < same else (i, c, v) for i, c, v in out]
    out[3:8] = [(3, None, out[3][2]), (4, 1, None), (5, 1, [float("nan")] * dims), (6, 1, [None, *out[6][2][1:]]), (7, 1, [float("inf")] * dims)]
    return out + [(None, 1, out[9][2]), (10, 2, out[11][2]), (12, 3, out[12][2][:2]), (13, 4, []), (-50, 5, out[14][2])]


@pytest.mark.parametrize("seed, n, same", [(1, 300, 0), (2, 300, 0.4), (3, 60, 0)])
def test_hard_negatives_equal_brute_force(spark, seed, n, same):
    rows = vectors(seed, n, same=same)
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, label int, embedding array<float>, q string, score int")
    exact = [(i, c, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, c, v in rows]
    expected = negatives_by_hand(exact)
    # several shards and blocks, and one of each
    for sizes in ({"shard_rows": 40, "block": 2}, {}):
        got = multi_index.hard_negatives(table.repartition(3), **sizes).collect()
        assert {tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got} == expected
        assert len(got) == len(expected) > 0


def test_hard_negatives_of_empty_tables(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert multi_index.hard_negatives(spark.createDataFrame([], schema)).collect() == []
    assert multi_index.hard_negatives(spark.createDataFrame([(1, 1, [0.5]), (2, 2, [0.1])], schema)).collect() == []
    assert multi_index.hard_negatives(spark.createDataFrame([(50, 1, [0.5])], schema)).collect() == []
    # vectors without components all score 0, which lies in the window of 0
    bare = multi_index.hard_negatives(spark.createDataFrame([(50, 1, []), (51, 1, []), (52, 2, [])], schema)).collect()
    assert [(r["anchor_id"], r["positive_id"], r["negative_id"], r["negative_score"]) for r in bare] == [(50, 51, 52, 0)]


def test_cells_come_by_falling_bound_and_hold_every_row():
    rng = np.random.default_rng(4)
    v = rng.integers(-200, 200, (500, 8)).astype(np.int64)
    v[100:140] = v[0]
    books = multi_index.codebook(v[:, :4], 6), multi_index.codebook(v[:, 4:], 6)
    index = multi_index.MultiIndex(np.arange(500), np.zeros(500, np.int64), v.astype(float), books)
    for q in v[:5]:
        visits = list(index.visits(q))
        assert [t for t, *_ in visits] == sorted((t for t, *_ in visits), reverse=True)
        assert sum(b - a for *_, a, b in visits) == 500
        for top, low, a, b in visits:
            scores = index.vectors[a:b] @ q
            assert low <= scores.min() and scores.max() <= top


def test_a_search_ends_before_all_cells():
    rng = np.random.default_rng(6)
    centres = rng.integers(-900, 900, (30, 8))
    v = (np.repeat(centres, 60, axis=0) + rng.integers(-9, 9, (1800, 8))).astype(np.int64)
    books = multi_index.codebook(v[:, :4]), multi_index.codebook(v[:, 4:])
    index = multi_index.MultiIndex(np.arange(1800), np.zeros(1800, np.int64), v.astype(float), books)
    looked = []
    whole = index.groups
    index.groups = lambda *a: (looked.append(len(g)) or g for g in whole(*a))
    ids, _ = index.positives(v[0].astype(float), 0, 0)
    order = sorted(range(1, 1800), key=lambda i: (-int(v[i] @ v[0]), i))[:5]
    assert ids.tolist() == order and sum(looked) < 1800


def test_large_numbers_stay_exact():
    big = np.array([[1 << 30, 3]], np.int64)
    assert multi_index.exact(big, big)[0].dtype == np.int64
    with pytest.raises(OverflowError):
        multi_index.exact(big << 3, big)
