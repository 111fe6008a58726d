"""Language by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in both directions, gives every position a probability for
each language, and a document's probabilities are the means over all its positions. It is
written and trained in numpy by backpropagation through time. A text is cut into consecutive
windows of WINDOW bytes, all of which are read (the state starts anew in each), so that many
windows move through the time steps together and memory does not depend on text length.
Gates use the piecewise linear sigmoid clip(x / 4 + 1 / 2, 0, 1).

Only text and non-null lang of rows outside fold 0 are learned from. SAMPLE documents are
shared out evenly among the languages (at least LEAST for each), chosen by a hash of the id,
so a rare language is learned at any size of the corpus; documents give PER_TEXT windows
each, spread over the whole text, those of a language with few documents up to MOST_WINDOWS.
At most LANGUAGES languages are learned, the commonest.

Defined results: ``und`` with score 0 for a text that is null or has no letter, and for all
if nothing was learned; ``keep_recognised`` then keeps every row, since no text can be told
to be of no language; repeated rows are judged alike; ties go to the language first in
order; an empty table gives an empty result. Further columns of any name do not matter.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, held_out, short_batches, steps

SAMPLE, PER_TEXT = 4000, 2
LEAST, MOST_WINDOWS, LANGUAGES = 200, 64, 256
WINDOW, HIDDEN = 96, 8
TRAIN_WINDOW, EPOCHS, BATCH, RATE = 48, 10, 256, 0.02
#: Windows that move through the network together.
TOGETHER = 2048


class ByteGRU:
    """A network of both directions: inputs (gate, direction x 256, H), recurrent (gate, direction, H, H).

    Gates are 0 (update), 1 (reset) and 2 (new state); each has arrays of its own, so that
    every step works on contiguous memory.
    """

    def __init__(self, languages, hidden=HIDDEN, seed=3):
        random, h = np.random.default_rng(seed), hidden
        self.languages, self.hidden = list(languages), h
        self.p = {
            "inputs": random.normal(0, 0.3, (3, 512, h)),
            "recurrent": random.normal(0, 0.5 / np.sqrt(h), (3, 2, h, h)),
            "out": random.normal(0, 0.3, (2, h, len(self.languages))),
            "bias": np.zeros(len(self.languages)),
        }
        self.p["inputs"][0] += 1.0  # update gates start open towards the past
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, x, keep=False):
        """Hidden states (T, 2, N, H) in reading order for bytes x (N, T); with ``keep`` the step values too."""
        h, n, t = self.hidden, *x.shape
        index = np.stack([x.T, x.T[::-1] + np.int64(256)], axis=1).astype(np.int64).reshape(t, 2 * n)
        out, kept = np.empty((t, 2, n, h), np.float32), []
        state = np.zeros((2, n, h), np.float32)
        for k in range(t):
            z, r, new = (self.p["inputs"][g].take(index[k], axis=0).reshape(2, n, h) for g in range(3))
            for g, gate in ((0, z), (1, r)):
                gate += state @ self.p["recurrent"][g]
                gate *= np.float32(0.25)
                gate += np.float32(0.5)
                np.clip(gate, 0, 1, out=gate)
            old = state @ self.p["recurrent"][2]
            new += r * old
            np.tanh(new, out=new)
            if keep:
                kept.append((state, z, r, old, new))
            state = np.subtract(state, new, out=out[k])
            state *= z
            state += new
        return (out, kept, index) if keep else out

    def probabilities(self, states):
        """(T, N, languages) probabilities of every position."""
        logits = states[:, 0] @ self.p["out"][0]
        logits += (states[:, 1] @ self.p["out"][1])[::-1]
        logits += self.p["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, x, y, weight):
        """Gradients of the weighted mean cross-entropy over all positions, back through time."""
        h, n, t = self.hidden, *x.shape
        states, kept, index = self.states(x, keep=True)
        slope = self.probabilities(states)  # (T, N, L)
        slope[:, np.arange(n), y] -= 1
        slope *= (weight / t / weight.sum())[:, None].astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["bias"] = slope.sum((0, 1))
        flows = np.stack([slope, slope[::-1]], axis=1)  # (T, 2, N, L) in reading order
        g["out"] = np.einsum("tdnh,tdnl->dhl", states, flows, optimize=True)
        back = flows @ self.p["out"].transpose(0, 2, 1)
        carried = np.zeros((2, n, h), np.float32)
        transposed = self.p["recurrent"].transpose(0, 1, 3, 2)
        into = np.empty((3, t, 2 * n, h), np.float32)
        for k in range(t - 1, -1, -1):
            state, z, r, old, new = kept[k]
            d = carried + back[k]
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (state - new) * np.float32(0.25) * ((z > 0) & (z < 1))
            d_r = d_new * old * np.float32(0.25) * ((r > 0) & (r < 1))
            carried = d * z
            for gate, d_in, d_rec in ((0, d_z, d_z), (1, d_r, d_r), (2, d_new, d_new * r)):
                into[gate, k] = d_in.reshape(2 * n, h)
                g["recurrent"][gate] += state.transpose(0, 2, 1) @ d_rec
                carried += d_rec @ transposed[gate]
        flat = index.ravel()
        for gate in range(3):
            for c in range(h):
                g["inputs"][gate, :, c] = np.bincount(flat, weights=into[gate, :, :, c].ravel(), minlength=512)
        return g


def train(x, y, languages, epochs=EPOCHS, seed=3) -> ByteGRU:
    """Adam over windows x (N, T) with language numbers y; rare languages weigh more."""
    net, random = ByteGRU(languages, seed=seed), np.random.default_rng(seed)
    share = np.bincount(y, minlength=len(languages)) / len(y)
    weight = np.minimum(10, 1 / (len(languages) * np.maximum(share, 1e-9)))[y]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, total = 0, epochs * -(-len(y) // BATCH)
    for _ in range(epochs):
        order = random.permutation(len(y))
        for low in range(0, len(y), BATCH):
            part = order[low : low + BATCH]
            step += 1
            rate = RATE * min(1.0, 2 * (1 - step / (total + 1)))
            for k, g in net.gradients(x[part], y[part], weight[part]).items():
                a, b = moments[k]
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                net.p[k] -= (rate * a / (1 - 0.9**step) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: ByteGRU, texts) -> np.ndarray:
    """(texts x languages) mean probabilities over all positions of whole texts; zeros if empty."""
    out = [np.zeros((0, len(net.languages)))]
    for low, high, data, offsets in steps(texts):
        n = high - low
        size = np.diff(offsets)
        windows = -(-size // WINDOW)
        owner = np.repeat(np.arange(n), windows)
        begin = offsets[owner] + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows))
        total = np.zeros((n, len(net.languages)))
        for a in range(0, len(owner), TOGETHER):
            at = begin[a : a + TOGETHER, None] + np.arange(WINDOW)
            inside = at < offsets[owner[a : a + TOGETHER] + 1][:, None]
            x = np.where(inside, data[np.minimum(at, len(data) - 1)], 0)
            p = net.probabilities(net.states(x))
            p *= inside.T[:, :, None]
            np.add.at(total, owner[a : a + TOGETHER], p.sum(0))
        out.append(total / np.maximum(size, 1)[:, None])
    return np.concatenate(out)


def sampled(learned: DataFrame, limit=SAMPLE) -> DataFrame:
    """(doc_id, windows): documents to learn from, shared out evenly among the languages."""
    counts = learned.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    each = max(-(-limit // max(len(counts), 1)), LEAST)
    known = learned.sparkSession.createDataFrame(
        [(r["lang"], r["count"], min(MOST_WINDOWS, max(PER_TEXT, PER_TEXT * each // r["count"]))) for r in counts],
        "lang string, n long, windows int",
    )
    keyed = learned.select("doc_id", "lang", F.xxhash64("doc_id").alias("key")).join(F.broadcast(known), "lang")
    # about twice the rows wanted of each language, so that no large language meets in one task
    few = keyed.where(f"n <= {2 * each} OR pmod(key, 1073741824) < {2 * each} * 1073741824D / n")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.expr("pmod(key, 1073741824)"), "doc_id"))
    chosen = few.withColumn("place", place).where(F.col("place") <= each)
    return chosen.groupBy("doc_id").agg(F.max("windows").alias("windows"))


def training_windows(docs: DataFrame, limit=SAMPLE):
    """(x, y, languages): windows of the sampled documents, cut out on the executors."""
    learned = docs.select("doc_id", "lang", "text").where(fold(F.col("doc_id")) != 0).where(
        F.col("lang").isNotNull() & (F.length("text") > 0)
    )
    ids = F.broadcast(sampled(learned, limit))  # two numbers a row, about ``limit`` rows
    rows = learned.join(ids, "doc_id").select("doc_id", "lang", "text", "windows")

    def run(batches):
        for batch in batches:
            made, windows = [], batch.column(3).to_pylist()
            for low, high, data, offsets in steps(batch.column(2)):
                for i in range(high - low):
                    body = data[offsets[i] : offsets[i + 1]]
                    n = windows[low + i]
                    places = {max(0, (len(body) - TRAIN_WINDOW) * (2 * k + 1) // (2 * n)) for k in range(n)}
                    made += [(low + i, body[at : at + TRAIN_WINDOW].tobytes()) for at in sorted(places)]
            rows = pa.array([i for i, _ in made], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()).take(rows), batch.column(1).take(rows), pa.array([w for _, w in made], pa.binary())],
                ["doc_id", "lang", "bytes"],
            )

    made = rows.mapInArrow(run, "doc_id string, lang string, bytes binary").orderBy("doc_id", "bytes")
    # repeated ids bring more rows than were chosen
    made = made.limit(2 * PER_TEXT * max(limit, LEAST * LANGUAGES))
    made = made.collect()
    languages = sorted({r["lang"] for r in made})
    x = np.zeros((len(made), TRAIN_WINDOW), np.uint8)
    for i, r in enumerate(made):
        x[i, : len(r["bytes"])] = np.frombuffer(bytes(r["bytes"]), np.uint8)
    return x, np.array([languages.index(r["lang"]) for r in made], np.int64), languages


def identify(docs: DataFrame, net, keep=()) -> DataFrame:
    """(doc_id, lang_pred, score, *keep) for every row; ``net`` None has learned nothing."""
    narrow = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"), *keep)
    if net is None:
        return narrow.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), *keep)
    fields = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in ("doc_id", *keep)) + ", lang_pred string, score double"

    def run(batches):
        for batch in batches:
            p = pooled(net, batch.column(1))
            best = p.argmax(1)
            read = batch.column(2).to_numpy(zero_copy_only=False).astype(bool) & (p.sum(1) > 0)
            names = pa.array([net.languages[k] if ok else "und" for k, ok in zip(best, read)], pa.string())
            score = pa.array(np.where(read, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], names, score], ["doc_id", *keep, "lang_pred", "score"])

    return narrow.mapInArrow(run, schema)


def learn(docs: DataFrame, limit=SAMPLE):
    short_batches(docs.sparkSession)
    x, y, languages = training_windows(docs, limit)
    return train(x, y, languages) if languages else None


def languages(docs: DataFrame, limit=SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``."""
    return identify(docs, learn(docs, limit)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def keep_recognised(docs: DataFrame, sure=0.4, limit=SAMPLE) -> DataFrame:
    """The rows of ``docs`` (all its columns) whose language is recognised with at least ``sure``.

    Without labelled rows nothing is learned and every row stays. Rows pass through Python whole, so nothing is shuffled.
    """
    net = learn(docs, limit)
    if net is None:
        return docs
    letters = docs.select(F.struct(*docs.columns).alias("kept_row"), "text", F.col("text").rlike(r"\p{L}").alias("has_letter"))

    def run(batches):
        for batch in batches:
            p = pooled(net, batch.column(1)).max(1)
            good = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False).astype(bool) & (p >= sure)
            rows = batch.column(0).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(rows.flatten(), docs_names)

    docs_names = docs.columns
    return letters.mapInArrow(run, docs.schema)
