"""Quality by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Every rule looks at one statistic of a text and votes good (1), bad (-1) or nothing (0).
No labels are used. The number of texts per vote pattern is counted on Spark (at most
3^rules patterns, whatever the corpus); expectation-maximisation over that small table
estimates how often a rule is right on good texts and on each kind of bad ones, and the
posterior of each pattern is joined back. All work on texts is built-in functions.

Defined results: a null or empty text has no words, base_failed is true and kept false;
repeated rows are judged alike; an empty table gives an empty result; a posterior of
exactly the threshold is kept. Only ``doc_id`` and ``text`` are read, so further columns
of any name do not matter.
"""

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut

#: name: (statistic, good when, bad when); statistics are columns of ``statistics``.
RULES = {
    "word_length": ("word_chars / n_words", "x BETWEEN 3 AND 9", "x < 2 OR x > 14"),
    "symbols": ("n_symbols / n_words", "x < 0.05", "x > 0.25"),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", "x <= 0.1", "x > 0.4"),
    "repeats": ("n_repeat_words / n_words", "x <= 0.05", "x > 0.2"),
    "variety": ("if(n_words < 20, 0.3D, n_distinct / sqrt(n_words) / 5)", "x > 0.8", "x < 0.25"),
    "capitals": ("n_upper / greatest(word_chars, 1)", "x < 0.15", "x > 0.5"),
    "shouts": ("n_shouts / n_words", "x < 0.05", "x > 0.25"),
}
VOTES = [f"vote_{name}" for name in RULES]
THRESHOLD = 0.5


def _removed(pattern):
    return f"CAST(length(regexp_replace(body, '{pattern}', '')) AS BIGINT)"


def statistics(docs: DataFrame, keep=()) -> DataFrame:
    """The contract's counts and those that the rules need, without a shuffle.

    Windows of five words are 64-bit hashes inside the row. Only a text in which one
    recurs sorts them (with positions) to count the words that recurring windows cover.
    ``keep`` names columns to carry along.
    """
    bare = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("body"))
    split = bare.selectExpr(
        "doc_id", *keep,
        f"regexp_extract_all(body, r'{WORD}', 0) AS words",
        rf"{_removed('[^#*$%&|<>]+')} AS n_symbols",
        rf"{_removed(r'[^\\p{Lu}]+')} AS n_upper",
        rf"{_removed('[^!?]+')} AS n_shouts",
        rf"filter(split(body, '\\n'), l -> l RLIKE r'{WORD}') AS lines",
    )
    hashed = split.selectExpr(
        "doc_id", *keep, "CAST(length(array_join(words, '')) AS BIGINT) AS word_chars", "n_symbols", "n_upper", "n_shouts",
        "CAST(size(words) AS BIGINT) AS n_words",
        "CAST(size(array_distinct(words)) AS BIGINT) AS n_distinct",
        "CAST(size(lines) AS BIGINT) AS n_lines",
        "CAST(size(lines) - size(array_distinct(lines)) AS BIGINT) AS n_dup_lines",
        "if(size(words) < 6, array(), transform(sequence(0, size(words) - 5), i -> "
        "xxhash64(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]))) AS windows",
    )
    rest = [c for c in hashed.columns if c != "windows"]
    ranked = hashed.selectExpr(
        *rest,
        "if(size(array_distinct(windows)) < size(windows), "
        "sort_array(transform(windows, (x, i) -> struct(x AS x, i AS i))), NULL) AS ranked",
    )
    twice = (
        "transform(filter(ranked, (s, k) -> coalesce(get(ranked, k - 1).x = s.x, false) "
        "OR coalesce(get(ranked, k + 1).x = s.x, false)), s -> s.i)"
    )
    covered = (
        f"aggregate(sort_array({twice}), struct(0L AS n, -5 AS last), "
        "(a, i) -> struct(a.n + CAST(least(5, i - a.last) AS BIGINT) AS n, i AS last), a -> a.n)"
    )
    return ranked.selectExpr(*rest, f"if(ranked IS NULL, 0L, {covered}) AS n_repeat_words")


def votes(stats: DataFrame) -> DataFrame:
    """Add one vote column per rule."""
    out = []
    for name, (value, good, bad) in RULES.items():
        x = f"({value})"
        out.append(
            f"CASE WHEN n_words = 0 THEN 0 WHEN {good.replace('x', x)} THEN 1 "
            f"WHEN {bad.replace('x', x)} THEN -1 ELSE 0 END AS vote_{name}"
        )
    return stats.selectExpr("*", *out)


def log_likelihoods(vote, model):
    """log(prior x likelihood) of a vote pattern for good texts (first) and each kind of bad ones."""
    return [
        math.log(prior) + sum(math.log((1 - bad) if v > 0 else bad) for v, bad in zip(vote, rates) if v)
        for prior, rates in model
    ]


def posteriors(vote, model):
    logs = log_likelihoods(vote, model)
    top = max(logs)
    odds = [math.exp(x - top) for x in logs]
    return [x / sum(odds) for x in odds]


def estimate(patterns, rounds=60):
    """EM over (votes, count) pairs: [(prior, P(bad vote) per rule)] of good texts and of kinds of bad ones.

    A rule sees one kind of junk and votes good on all others, so a single class of bad
    texts would let the commonest kind hide the rest. There is one latent kind per rule,
    started where that rule is mostly right (0.8) and the others seldom speak up (0.1).
    Rules are taken to be wrong on at most 1 % of good texts and right on half of their own
    kind at least, which keeps the classes from changing places. Ten texts' worth of the
    starting rates are added to the counts. Votes not cast say nothing.
    """
    n_rules = len(VOTES)
    start = [[0.005] * n_rules] + [[0.8 if j == k else 0.1 for j in range(n_rules)] for k in range(n_rules)]
    model = [(0.8 if k == 0 else 0.2 / n_rules, rates) for k, rates in enumerate(start)]
    patterns = sorted((tuple(v), n) for v, n in patterns if any(v))
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        size = [0.0] * len(model)
        cast, bad = ([[0.0] * n_rules for _ in model] for _ in range(2))
        for vote, n in patterns:
            for k, p in enumerate(posteriors(vote, model)):
                size[k] += n * p
                for j, v in enumerate(vote):
                    if v:
                        cast[k][j] += n * p
                        bad[k][j] += n * p * (v < 0)
        model = []
        for k, first in enumerate(start):
            rates = [(bad[k][j] + 10 * first[j]) / (cast[k][j] + 10) for j in range(n_rules)]
            if k == 0:
                rates = [min(0.01, r) for r in rates]
            else:
                rates[k - 1] = max(0.5, rates[k - 1])
            model.append(((size[k] + 1) / (total + len(start)), [min(0.999, max(0.0005, r)) for r in rates]))
    return model


def learn(voted: DataFrame):
    """Count vote patterns on Spark (map-side combined) and run EM over them."""
    rows = voted.groupBy(*VOTES).count().collect()  # at most 3^7 = 2187 rows
    return estimate([([r[v] for v in VOTES], r["count"]) for r in rows])


def accuracies(model):
    """Per rule: (name, right on good texts, right on bad texts), abstentions aside."""
    bad = sum(prior for prior, _ in model[1:])
    return [
        (name, 1 - model[0][1][j], sum(prior * rates[j] for prior, rates in model[1:]) / bad)
        for j, name in enumerate(RULES)
    ]


def judge(stats: DataFrame, model) -> DataFrame:
    """Add votes, posterior, base_failed and kept.

    The posterior of every possible pattern (3^7 rows) is broadcast.
    """
    rows = [(*vote, posteriors(vote, model)[0]) for vote in itertools.product((-1, 0, 1), repeat=len(VOTES))]
    schema = ", ".join(f"{v} INT" for v in VOTES) + ", posterior DOUBLE"
    known = F.broadcast(stats.sparkSession.createDataFrame(rows, schema))
    failed = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
    return (
        votes(stats).join(known, VOTES).selectExpr("*", f"{failed} AS base_failed")
        .selectExpr("*", f"NOT base_failed AND posterior >= {THRESHOLD} AS kept")
    )


def weak_quality(docs: DataFrame) -> DataFrame:
    """Counts, votes, posterior and verdict for every row of (doc_id, text).

    The statistics are written to the shared folder (numbers only): texts are read once.
    """
    stats = cut(statistics(docs))
    return judge(stats, learn(votes(stats)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all its columns) that are kept.

    Statistics are made once for the vote counts and once more beside the rows: shuffling
    whole texts to join verdicts back would cost more.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("kept_row"), "doc_id", "text")
    model = learn(votes(cut(statistics(docs))))
    beside = statistics(keyed, keep=("kept_row",))
    # behind a generator the filter can't be pushed down, which would repeat all expressions in it
    numbers = F.struct(*[c for c in beside.columns if c not in ("doc_id", "kept_row")])
    sealed = beside.select("kept_row", F.inline(F.array(numbers)))
    return judge(sealed, model).where("kept").select("kept_row.*")
