"""Secret scans: base patterns, and probabilistic automata inferred from what they find.

The credentials that the base patterns find are the labelled ones, by kind. Each kind's
strings form a prefix tree, whose states are merged level by level: states of one depth are
compatible if the shares of their next symbols (end of string included), of the classes of
these, and those of their successors, differ by less than the Hoeffding bound of their counts; a state joins the first
compatible group in order of size, among its siblings first, then among all. What is left is a probabilistic automaton that knows a
format's length, prefix and alphabet: a step that no labelled string took with a symbol of
that class (upper, lower, digit, punctuation by sign, end) has no likelihood. Symbols past
LEVELS share one tail state.

A candidate is a maximal run of the credential alphabet, punctuation trimmed, of at least
SHORTEST characters, that touches no base span. All are scored: the likelihood of the kinds,
weighted by how often each occurs, against that of an automaton of the same sort inferred
from ordinary candidates (there any step has some likelihood), weighted likewise. From odds
of ODDS on a candidate is a span of kind ``format``; that finds a credential whose format was seen at a keyword and which now
stands alone. Ordinary strings that are of a kind's format are left out of the ordinary
automaton (at most a twentieth).

Learning takes at most SAMPLE distinct strings of each kind, of at most LONGEST characters,
those of least hash; how often kinds occur is counted over all texts. Base spans are always
kept. A kind with fewer than FEW strings has no automaton.

Defined results: null and empty texts have no spans; repeated rows have the same spans; very
long texts are runs of their own; without labelled strings only base spans are found; an
empty table gives an empty result. Further columns of any name do not matter.
"""

import heapq
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches, span_hashes, steps, stored, tokens

#: Fixed values of the contract: patterns and least lengths.
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex")
ADDED = "format"

SHORTEST, ODDS = 12, 10.0
SAMPLE, LONGEST, FEW = 4_000, 256, 20
LEVELS, DOUBT = 48, 0.05
#: Symbols that smoothing adds to a state of the ordinary automaton, and to one of a format.
ALPHA, CLASS_ALPHA = 1.0, 16.0

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
END = len(ALPHABET)
SYMBOL = np.full(256, END, np.uint8)
SYMBOL[list(ALPHABET)] = np.arange(END)
CREDENTIAL = SYMBOL < END
#: Symbol by class: upper case, lower case, digits, and every other symbol (the end too) by itself.
_CLASS = [0] * 26 + [1] * 26 + [2] * 10 + list(range(3, 10))
CLASSES = np.eye(10)[_CLASS]
SOLID = CREDENTIAL & ~np.isin(np.arange(256), list(b"+/_.=-"))
HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))


def base_spans(data, offsets):
    """(row, kind number, start, end, start of the credential) by row; places are bytes of the run."""
    found = []
    start, end, row = tokens(data, offsets, HEX)
    for k in np.flatnonzero(end - start >= HEX_LEAST):
        found.append((int(row[k]), 2, int(start[k]), int(end[k]), int(start[k])))
    body = data.tobytes()
    for i, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for m in ASSIGN.finditer(body, low, high):
            if m.end() - m.start(2) >= ASSIGN_LEAST:
                found.append((i, 0, m.start(), m.end(), m.start(2)))
        for m in ACCESS.finditer(body, low, high):
            if m.end() - m.start() >= ACCESS_LEAST:
                found.append((i, 1, m.start(), m.end(), m.start()))
    return sorted(found, key=lambda f: (f[0], f[2], f[1]))


def trimmed(data, start, end):
    """Spans from their first letter or digit to their last one and up to two ``=`` behind it."""
    solid = np.append(np.flatnonzero(SOLID[data]), len(data))
    low = solid[np.searchsorted(solid, start)]
    last = np.searchsorted(solid, end) - 1
    high = np.where(last >= 0, solid[np.maximum(last, 0)] + 1, start)
    for _ in range(2):
        high = high + ((high < end) & (data[np.minimum(high, len(data) - 1)] == 61))
    return low, np.maximum(high, low)


def candidates(data, offsets, base):
    """(start, end, row) of the candidates that touch no base span."""
    start, end, row = tokens(data, offsets, CREDENTIAL)
    if not len(start):
        return start, end, row
    start, end = trimmed(data, start, end)
    covered = np.zeros(len(data) + 1, np.int64)
    for _, _, a, b, _ in base:
        covered[a] += 1
        covered[b] -= 1
    touched = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    free = (end - start >= SHORTEST) & (touched[end] == touched[start])
    return start[free], end[free], row[free]


def symbols(data, start, end):
    """The first LEVELS + 1 symbols of each span, END from its end on."""
    at = start[:, None] + np.arange(LEVELS + 1)
    return np.where(at < end[:, None], SYMBOL[data[np.minimum(at, len(data) - 1)]], END).astype(np.uint8)


class Automaton:
    """Levels of states; ``weights`` are log probabilities by state and symbol, ``following`` the next state.

    The last state of each level is for strings that have left the automaton.
    """

    def __init__(self, levels, tail):
        self.levels, self.tail = levels, tail

    def likelihood(self, data, start, end):
        """log probability of each span, to its whole length."""
        table, size = symbols(data, start, end), end - start
        state, total, alive = np.zeros(len(start), np.int64), np.zeros(len(start)), np.ones(len(start), bool)
        for d, (weights, following) in enumerate(self.levels):
            s = table[:, d]
            total[alive] += weights[state[alive], s[alive]]
            alive &= s < END
            state[alive] = following[state[alive], s[alive]]
        # what is left goes through the tail state
        if alive.any():
            sums = np.concatenate([[0.0], np.cumsum(self.tail[SYMBOL[data]])])
            total[alive] += sums[end[alive]] - sums[start[alive] + LEVELS] + self.tail[END]
        return total


def smoothed(counts):
    """log probabilities from counts, ALPHA symbols spread over all."""
    return np.log((counts + ALPHA / (END + 1)) / (counts.sum(-1, keepdims=True) + ALPHA))


def strict(counts):
    """log probabilities from counts, CLASS_ALPHA symbols spread over the classes that were seen; nothing else is of the format."""
    n = counts.sum(-1, keepdims=True)
    shares = (counts @ CLASSES) / np.maximum(n, 1) @ (CLASSES / CLASSES.sum(0)).T
    with np.errstate(divide="ignore"):
        return np.log((counts + CLASS_ALPHA * shares) / np.where(n > 0, n + CLASS_ALPHA, 1))


def bound(a, b):
    """Hoeffding bound on the difference of two shares of a and of b cases."""
    return math.sqrt(0.5 * math.log(2 / DOUBT)) * (1 / np.sqrt(a) + 1 / np.sqrt(b))


def shares(counts):
    """Counts of symbols and of their classes."""
    return np.concatenate([counts, counts @ CLASSES], axis=-1)


def compatible(table, a, b, d):
    """Whether the rows ``a`` and ``b`` go on alike from level ``d``."""
    if d > LEVELS or bound(len(a), len(b)) >= 1:
        return True
    x, y = (np.bincount(table[r, d], minlength=END + 1) for r in (a, b))
    if np.abs(shares(x) / len(a) - shares(y) / len(b)).max() > bound(len(a), len(b)):
        return False
    return all(
        compatible(table, a[table[a, d] == s], b[table[b, d] == s], d + 1)
        for s in np.flatnonzero(np.minimum(x, y)[:END])
    )


def grouped(table, members, d):
    """The group of each state (an array of rows) at level ``d``; groups by order of size."""
    groups, of = [], np.zeros(len(members), np.int64)
    counts = shares(np.stack([np.bincount(table[m, d], minlength=END + 1) for m in members]))
    pooled = np.zeros_like(counts)
    for k in sorted(range(len(members)), key=lambda k: (-len(members[k]), k)):
        n = len(members[k])
        sizes = np.array([len(g) for g in groups], float)
        # the first step of the test for all groups at once
        apart = np.abs(pooled[: len(groups)] / np.maximum(sizes, 1)[:, None] - counts[k] / n).max(1, initial=0)
        near = np.flatnonzero(apart <= bound(n, np.maximum(sizes, 1))) if len(groups) else []
        to = next((g for g in near if compatible(table, groups[g], members[k], d)), len(groups))
        if to == len(groups):
            groups.append(members[k])
        else:
            groups[to] = np.concatenate([groups[to], members[k]])
        pooled[to] += counts[k]
        of[k] = to
    return of, groups


def packed(strings):
    """The bytes of all strings, and where each starts and ends."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
    return data, edges[:-1], edges[1:]


def infer(strings, weigh=strict) -> Automaton:
    """The automaton of distinct strings (bytes); ``weigh`` makes log probabilities of counts."""
    data, start, end = packed(strings)
    table = symbols(data, start, end)
    groups, levels = [np.arange(len(strings))], []
    for d in range(LEVELS):
        counts = np.array([np.bincount(table[g, d], minlength=END + 1) for g in groups]).reshape(-1, END + 1)
        # states that are too small for the test join their siblings before strangers
        pools, came, pool_of = [], [], []
        for k, g in enumerate(groups):
            after = np.flatnonzero(counts[k, :END])
            if len(after):
                near, merged = grouped(table, [g[table[g, d] == s] for s in after], d + 1)
                came += [(k, s) for s in after]
                pool_of += (near + len(pools)).tolist()
                pools += merged
        to_group, onward = grouped(table, pools, d + 1) if pools else (np.zeros(0, np.int64), [])
        of = to_group[pool_of] if pools else to_group
        following = np.full((len(groups) + 1, END), len(onward), np.int64)
        if weigh is strict:
            # an unseen symbol goes where the commonest one of its class goes
            for (k, s), to in sorted(zip(came, of), key=lambda x: counts[x[0]]):
                following[k, CLASSES[:END, _CLASS[s]] > 0] = to
        for (k, s), to in zip(came, of):
            following[k, s] = to
        levels.append((weigh(np.vstack([counts, np.zeros((1, END + 1))])), following))
        groups = onward
    longer = end - start > LEVELS
    rest = [SYMBOL[data[a + LEVELS : b]] for a, b in zip(start[longer], end[longer])]
    tail = np.bincount(np.concatenate([*rest, np.zeros(0, np.uint8)]).astype(np.int64), minlength=END + 1)
    tail[END] = longer.sum()
    return Automaton(levels, smoothed(tail) if longer.any() or weigh is smoothed else np.full(END + 1, -np.inf))


class Formats:
    """Automata of the kinds and of ordinary strings, each with how often it occurs."""

    def __init__(self, kinds, ordinary):
        self.kinds, self.ordinary = kinds, ordinary

    def log_odds(self, data, start, end):
        """log of (credential likelihood : ordinary likelihood), both weighted by their counts."""
        if not self.kinds or not len(start):
            return np.full(len(start), -np.inf)
        each = [math.log(n) + a.likelihood(data, start, end) for a, n in self.kinds]
        against = self.ordinary[0].likelihood(data, start, end) + math.log(max(self.ordinary[1], 1))
        return np.logaddexp.reduce(each, axis=0) - against


def learned(strings, counts) -> Formats:
    """Formats of {kind: strings (bytes)} and {kind: occurrences}; ordinary strings are those of kind ''."""
    kinds, ordinary = [], sorted(strings.get("", []))
    like = np.full(len(ordinary), -np.inf)
    for kind in KINDS:
        own = sorted(strings.get(kind, []))
        if len(own) >= FEW:
            kinds.append((infer(own), counts[kind]))
            like = np.maximum(like, kinds[-1][0].likelihood(*packed(ordinary)))
    # those that are of a format, the likeliest first
    alike = np.flatnonzero(like > -np.inf)
    alike = set(alike[np.argsort(-like[alike], kind="stable")][: len(ordinary) // 20].tolist())
    kept = [s for k, s in enumerate(ordinary) if k not in alike]
    return Formats(kinds, (infer(kept, smoothed), counts.get("", 0)))


def _least(pool, most):
    """The ``most`` strings of least hash."""
    return dict(heapq.nsmallest(most, pool.items(), key=lambda x: (x[1], x[0]))) if len(pool) > most else pool


def labelled_strings(docs: DataFrame, sample=SAMPLE) -> tuple[dict, dict]:
    """({kind: distinct strings}, {kind: occurrences}) over all texts; kind '' holds ordinary candidates.

    A task keeps at most ``sample`` strings of a kind, so what it sends is bounded.
    """

    def run(batches):
        pools, counts = {k: {} for k in ("", *KINDS)}, dict.fromkeys(("", *KINDS), 0)
        for batch in batches:
            for _, _, data, offsets in steps(batch.column(0)):
                base = base_spans(data, offsets)
                spans = [(KINDS[f[1]], f[4], f[3]) for f in base]
                inside = {"": candidates(data, offsets, base)[:2]}
                for kind in KINDS:
                    ab = np.array([s[1:] for s in spans if s[0] == kind], np.int64).reshape(-1, 2)
                    a, b = trimmed(data, ab[:, 0], ab[:, 1]) if len(ab) else (ab[:, 0], ab[:, 1])
                    inside[kind] = a[b - a >= SHORTEST], b[b - a >= SHORTEST]
                for kind, (a, b) in inside.items():
                    counts[kind] += len(a)
                    use = b - a <= LONGEST
                    a, b = a[use], b[use]
                    keys = span_hashes(data, a, b) if len(a) else a
                    keys, near = np.unique(keys, return_index=True)
                    a, b, keys = a[near[:sample]], b[near[:sample]], keys[:sample]
                    for x, y, key in zip(a.tolist(), b.tolist(), keys.tolist()):
                        pools[kind][data[x:y].tobytes()] = key
                    if len(pools[kind]) > 2 * sample:
                        pools[kind] = _least(pools[kind], sample)
        rows = [(kind, key >> 1, s.decode(), 0) for kind, pool in pools.items() for s, key in _least(pool, sample).items()]
        rows += [(kind, -1, None, n) for kind, n in counts.items() if n]
        columns = list(zip(*rows)) or [(), (), (), ()]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "key", "string", "n"])

    seen = stored(docs.select("text").mapInArrow(run, "kind string, key long, string string, n long"))
    counts = {r["kind"]: r["n"] for r in seen.where("string IS NULL").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    distinct = seen.where("string IS NOT NULL").groupBy("kind", "key", "string").count()
    strings = {}
    for kind in ("", *KINDS):
        least = distinct.where(F.col("kind") == kind).orderBy("key", "string").limit(sample)
        strings[kind] = [r["string"].encode() for r in least.select("string").collect()]
    return strings, counts


def spans_of(data, offsets, formats, odds=ODDS):
    """For each text its (kind, start, end, log odds) in code points, by start, then kind as listed; base spans have no odds."""
    base = base_spans(data, offsets)
    start, end, row = candidates(data, offsets, base)
    value = formats.log_odds(data, start, end)
    sure = np.flatnonzero(value >= math.log(odds))
    found = [(r, k, a, b, None) for r, k, a, b, _ in base]
    found += [(int(row[k]), len(KINDS), int(start[k]), int(end[k]), float(value[k])) for k in sure]
    lists = [[] for _ in range(len(offsets) - 1)]
    names = (*KINDS, ADDED)
    for r, k, a, b, v in sorted(found, key=lambda f: (f[0], f[2], f[1])):
        before, inside = data[offsets[r] : a], data[a:b]
        low = int(np.count_nonzero((before & 0xC0) != 0x80))
        lists[r].append((names[k], low, low + int(np.count_nonzero((inside & 0xC0) != 0x80)), v))
    return lists


SPANS = "array<struct<kind: string, start: bigint, stop: bigint, log_odds: double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("log_odds", pa.float64())]))


def secrets(docs: DataFrame, formats: Formats | None = None, sample=SAMPLE, odds=ODDS) -> DataFrame:
    """(doc_id, spans) for every row: places of credentials in code points, end exclusive."""
    spark = docs.sparkSession
    short_batches(spark)
    if formats is None:
        formats = learned(*labelled_strings(docs, sample))
    shared = spark.sparkContext.broadcast(formats)  # at most four automata of ``sample`` strings
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        names = ("kind", "start", "stop", "log_odds")
        for batch in batches:
            lists = []
            for _, _, data, offsets in steps(batch.column(1)):
                lists += [[dict(zip(names, s)) for s in of] for of in spans_of(data, offsets, shared.value, odds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, _SPANS)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans {SPANS}")


def joined(spans: str) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')")
