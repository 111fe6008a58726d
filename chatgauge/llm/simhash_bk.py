"""Near-duplicates by SimHash, linked with BK-trees, and their connected components.

Fingerprints are made in one pass over whole texts. Equal fingerprints become one row (a
map-side combined count), so copies are never expanded into pairs. Two fingerprints that
differ in at most 3 of 64 bits agree on at least two of five bit blocks; each fingerprint
therefore goes to ten shards (pair of blocks, their value), and only fingerprints of one
shard are compared, exactly. A shard's fingerprints form a BK-tree: a child hangs below its
parent under their Hamming distance d, and a search for radius r follows the edges d - r to
d + r. The trees of all shards in a task are built and searched together as flat arrays.

A shard with more than TREE_MAX fingerprints is dealt over several trees of bounded size;
each of its fingerprints is then sent as a query to the trees numbered below its own, so
that every pair meets once. Trees travel with their shard instead of being broadcast,
since together they grow with the corpus. A task links what it finds to one fingerprint of
each group, not pair by pair; the links are joined to components by alternating star
contraction, each round written to the shared folder.

Defined results: null and empty texts have fingerprint zero and are linked like others; a
null doc_id gets a component but never names one (null if the whole component has no id);
repeated rows share a component; an empty table gives an empty result. Further columns of
any name do not matter.
"""

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACES, cut, short_batches, signed, steps, tokens

RADIUS = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
TREE_MAX = 4096
#: Pairs of query and tree node that one numpy step holds.
FRONT = 1 << 20
WORD_BYTES = ~SPACES


def text_fingerprints(texts) -> np.ndarray:
    """64-bit fingerprints of an Arrow array of texts."""
    from xxhash import xxh64_intdigest

    out = [np.zeros(0, np.uint64)]
    for low, high, data, offsets in steps(texts):
        lowered = LOWER[data]
        start, end, row = tokens(lowered, offsets, WORD_BYTES)
        made = np.zeros(high - low, np.uint64)
        if len(start):
            # words joined by single blanks: a shingle is then one slice
            size = end - start
            stop = np.cumsum(size + 1) - 1
            first = stop - size
            within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            joined = np.full(int(stop[-1]) + 1, 32, np.uint8)
            joined[np.repeat(first, size) + within] = lowered[np.repeat(start, size) + within]
            text = joined.tobytes()
            edge = np.flatnonzero(np.diff(row)) + 1
            begin, finish = np.concatenate([[0], edge]), np.concatenate([edge, [len(row)]])
            count = np.maximum(finish - begin - 2, 1)
            lead = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
            tail = np.minimum(lead + 2, np.repeat(finish, count) - 1)
            hashes = np.fromiter(
                (xxh64_intdigest(text[a:b], 42) for a, b in zip(first[lead].tolist(), stop[tail].tolist())),
                np.uint64, len(lead),
            )
            made[row[begin]] = majority(hashes, np.concatenate([[0], np.cumsum(count)]))
        out.append(made)
    return np.concatenate(out)


def majority(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Per run of hashes, the bits that are set in over half of them."""
    out = np.zeros(len(edges) - 1, np.uint64)
    low = 0
    while low < len(out):
        # runs together up to a million hashes; a longer run is summed in parts
        high = max(low + 1, int(np.searchsorted(edges, edges[low] + (1 << 18), "right")) - 1)
        part = hashes[edges[low] : edges[high]]
        at = edges[low:high] - edges[low]
        sums = np.zeros((high - low, 64), np.int64)
        for k in range(8):
            byte = ((part >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
            bits = np.unpackbits(byte[:, None], axis=1, bitorder="little")
            sums[:, 8 * k : 8 * k + 8] = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        over = 2 * sums > np.diff(edges[low : high + 1])[:, None]
        out[low:high] = (over.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        low = high
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key1, key2, fp) for every row; fp holds the 64 bits as a signed long.

    The keys are hashes of id and text, by which a row can be found again.
    """
    narrow = docs.select(
        "text", "doc_id", F.xxhash64("doc_id", "text").alias("key1"), F.hash("doc_id", "text").alias("key2")
    )
    names = [*narrow.columns[1:], "fp"]

    def run(batches):
        for batch in batches:
            made = pa.array(signed(text_fingerprints(batch.column(0))))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], names)

    short_batches(docs.sparkSession)
    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields[1:], T.StructField("fp", T.LongType())]))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _distance(a, b):
    return np.bitwise_count(a ^ b).astype(np.int64)


def grow(fp: np.ndarray, tree: np.ndarray):
    """BK-trees of all groups at once: (depth-first-free) arrays parent and edge; a root has parent -1.

    ``tree`` numbers the group of each fingerprint. All that still sink compare themselves
    with the node they hang at; the first of each (node, distance) becomes its child.
    """
    n = len(fp)
    parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    _, root, member = np.unique(tree, return_index=True, return_inverse=True)
    at = root[member]
    sinking = np.setdiff1d(np.arange(n), root, assume_unique=True)
    while len(sinking):
        d = _distance(fp[sinking], fp[at[sinking]])
        _, first, group = np.unique(at[sinking] * 65 + d, return_index=True, return_inverse=True)
        child = sinking[first]
        parent[child], edge[child] = at[child], d[first]
        at[sinking] = child[group]
        rest = np.ones(len(sinking), bool)
        rest[first] = False
        sinking = sinking[rest]
    return parent, edge


def search(fp, parent, edge, roots, query, query_root, radius=RADIUS):
    """(query, node) pairs within the radius; follows only edges of d - radius to d + radius."""
    key = parent * 65 + edge
    order = np.argsort(key, kind="stable")
    key = key[order]
    pending = [(np.arange(len(query)), query_root)]
    while pending:
        q, node = pending.pop()
        if len(q) > FRONT:
            half = len(q) // 2
            pending += [(q[:half], node[:half]), (q[half:], node[half:])]
            continue
        d = _distance(query[q], fp[node])
        near = d <= radius
        if near.any():
            yield q[near], node[near]
        low = np.searchsorted(key, node * 65 + np.maximum(d - radius, 0))
        high = np.searchsorted(key, node * 65 + np.minimum(d + radius, 64), "right")
        width = high - low
        total = int(width.sum())
        if total:
            for a, b in _halves(width):
                part = width[a:b]
                shift = np.repeat(low[a:b] - np.concatenate([[0], np.cumsum(part)[:-1]]), part)
                pending.append((np.repeat(q[a:b], part), order[shift + np.arange(int(part.sum()))]))


def _halves(width):
    """Runs of rows whose widths sum to about FRONT."""
    ends = np.cumsum(width)
    low = 0
    while low < len(width):
        base = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, base + FRONT, "right")))
        yield low, high
        low = high


def _find(label, x):
    while True:
        up = label[x]
        if np.array_equal(up, x):
            return x
        x = up


def unite(label, a, b):
    """Union by smallest index, for arrays of pairs at once."""
    while True:
        ra, rb = _find(label, a), _find(label, b)
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))


def shard_links(rows: pd.DataFrame, radius=RADIUS):
    """(a, b) links that join each group of near fingerprints found in whole shards.

    ``rows`` has shard, tree, fp and stored (part of the tree, else only a query of it).
    """
    rows = rows.sort_values(["shard", "tree", "stored", "fp"], ascending=[True, True, False, True], kind="stable")
    fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
    stored = rows["stored"].to_numpy(bool)
    new = np.ones(len(rows), bool)
    new[1:] = (rows["shard"].to_numpy()[1:] != rows["shard"].to_numpy()[:-1]) | (
        rows["tree"].to_numpy()[1:] != rows["tree"].to_numpy()[:-1]
    )
    tree = np.cumsum(new) - 1
    inner = np.flatnonzero(stored)
    parent, edge = grow(fp[inner], tree[inner])
    root = np.full(int(tree[-1]) + 1, -1, np.int64)
    is_root = np.flatnonzero(parent < 0)
    root[tree[inner[is_root]]] = is_root
    asking = np.flatnonzero(root[tree] >= 0)
    label = np.arange(len(fp))
    for q, node in search(fp[inner], parent, edge, root, fp[asking], root[tree[asking]], radius):
        unite(label, asking[q], inner[node])
    top = _find(label, label.copy())
    linked = np.flatnonzero(top != np.arange(len(fp)))
    return pd.DataFrame({"a": signed(fp[top[linked]]), "b": signed(fp[linked])}).query("a != b").drop_duplicates()


def links(distinct: DataFrame, radius=RADIUS, tree_max=TREE_MAX) -> DataFrame:
    """(a, b): enough near pairs of the distinct fingerprints to connect all that are linked."""
    def block(first, width):
        return F.shiftrightunsigned("fp", first).bitwiseAND((1 << width) - 1)

    # 64 - 3 differing bits leave two of five blocks untouched
    keys = [
        (block(*BLOCKS[i]) * 8192 + block(*BLOCKS[j])) * 16 + k
        for k, (i, j) in enumerate(itertools.combinations(range(5), 2))
    ]
    sharded = distinct.select("fp", F.explode(F.array(*keys)).alias("shard"))
    sizes = sharded.groupBy("shard").count().where("count > 1").select(
        F.col("shard"), F.expr(f"CAST(ceil(count / {tree_max}) AS INT)").alias("trees")
    )
    met = sharded.join(sizes, "shard")
    # its own tree stores a fingerprint; those numbered below are asked for it
    own = "CAST(pmod(xxhash64(fp), trees) AS INT)"
    sent = met.selectExpr("shard", "fp", f"{own} AS own", f"explode(sequence(0, {own})) AS tree").selectExpr(
        "shard", "fp", "tree", "tree = own AS stored"
    )
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (rows["shard"] == rows["shard"].iloc[-1]) & (rows["tree"] == rows["tree"].iloc[-1])
            if int(last.sum()) >= 10 * tree_max:
                # the tree is complete (it comes first): later queries only need the tree itself
                yield shard_links(rows, radius)
                held = rows[last & rows["stored"]]
            elif len(rows) - int(last.sum()) >= 20_000:
                yield shard_links(rows[~last], radius)
                held = rows[last]
            else:
                held = rows
        if held is not None and len(held):
            yield shard_links(held, radius)

    grouped = sent.repartition(parts, "shard", "tree").sortWithinPartitions("shard", "tree", F.desc("stored"))
    return grouped.mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, by alternating star contraction.

    Large star: every larger neighbour goes to the smallest neighbour. Small star: so do the
    smaller ones. Both keep components and end with a star around each smallest node. Sums
    over a node's neighbours are minima, combined before the shuffle.
    """
    edges = cut(edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u <> v").distinct())
    seen = None
    while True:
        both = edges.select("u", "v").union(edges.selectExpr("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        small = met.selectExpr("u", "m AS v").union(met.where("v <> m").selectExpr("v AS u", "m AS v")).where("u <> v")
        edges = cut(small.distinct())
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(state) == seen:
            return edges.selectExpr("u AS node", "v AS root")
        seen = tuple(state)


def classes(prints: DataFrame, radius=RADIUS, tree_max=TREE_MAX):
    """Distinct fingerprints with their component, and the components with their first row."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key1", "key2")
    distinct = cut(prints.groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("copies")))
    nodes = components(links(distinct.select("fp"), radius, tree_max))
    inside = nodes.selectExpr("node AS fp", "root").union(nodes.selectExpr("root", "root").distinct())
    rooted = distinct.join(inside, "fp", "left").withColumn("root", F.expr("coalesce(root, fp)"))
    named = rooted.groupBy("root").agg(F.min("first").alias("first"), F.sum("copies").alias("component_size"))
    return rooted.select("fp", "root"), named


def near_duplicates(docs: DataFrame, radius=RADIUS, tree_max=TREE_MAX) -> DataFrame:
    """(doc_id, fp, component_id, component_size) for every row."""
    prints = cut(fingerprints(docs))
    rooted, named = classes(prints, radius, tree_max)
    known = rooted.join(named, "root").selectExpr("fp", "first.doc_id AS component_id", "component_size")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id", "component_size")


def keep_one(docs: DataFrame, radius=RADIUS, tree_max=TREE_MAX) -> DataFrame:
    """One row of each component (columns of ``docs``): of its smallest doc_id, rows with an id first.

    Rows that agree in id and text count as one row.
    """
    _, named = classes(cut(fingerprints(docs)), radius, tree_max)
    kept = named.selectExpr("first.key1 AS kept_key1", "first.key2 AS kept_key2")
    keyed = docs.select(
        F.struct(*docs.columns).alias("kept_row"), F.xxhash64("doc_id", "text").alias("kept_key1"),
        F.hash("doc_id", "text").alias("kept_key2"),
    )
    keys = ["kept_key1", "kept_key2"]
    return keyed.join(kept, keys, "left_semi").dropDuplicates(keys).select("kept_row.*")
