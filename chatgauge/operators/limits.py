"""First-N rows by position, without moving the rows themselves.

Only positions are looked at to find the cut, the largest position kept; the table is then
filtered by ``position <= cut``, which reaches the file scan, so row groups past the cut are
skipped. Up to GATHERED rows the cut is part of the plan: the N smallest positions are found
in two stages (spread over salts, then merged). Beyond that it is found by distributed
selection: positions are counted between splitters taken from a sample, the range that holds
row N is cut up again, and so on until few positions are left. A round is one aggregate
without a row leaving its task; N may be any part of the table.

Positions must be unique: if the first row left out has the position of the last one kept,
the job fails (the selection fails while it looks for the cut).
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Positions that may meet in one task; up to so many, Spark prunes a ranking before it shuffles.
GATHERED = 1000
#: Parts into which a round cuts a range, and sampled positions for each.
PARTS, PER_PART = 64, 32

NOT_UNIQUE = "positions of a first-N cut are not unique"


def _salts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _unique(cut, following):
    """``cut``, unless the next position is the same."""
    return F.when(cut == following, F.raise_error(F.lit(NOT_UNIQUE))).otherwise(cut)


def _literal(value, dtype):
    if isinstance(dtype, T.StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in dtype.fields])
    return F.lit(value).cast(dtype)


def _within(positions: DataFrame, ranges: dict, dtype) -> DataFrame:
    """(task, position) of the tasks in ``ranges`` between their bounds, both ends included."""
    if len(ranges) == 1:
        (task, (low, high)), = ranges.items()
        at = F.col("position")
        inside = (at >= _literal(low, dtype)) & (at <= _literal(high, dtype))
        return positions.where(inside & (F.col("task") == task))
    schema = T.StructType([T.StructField("task", T.StringType()), T.StructField("low", dtype), T.StructField("high", dtype)])
    # one row for each capped task, and the caps come from the driver
    known = F.broadcast(positions.sparkSession.createDataFrame([(t, *r) for t, r in ranges.items()], schema))
    return positions.join(known, "task").where("position >= low AND position <= high").select("task", "position")


def _splitters(rows: DataFrame, sizes: dict, turn: int) -> dict:
    """Up to PARTS - 1 positions of each task, spread evenly over a sample."""
    every = F.create_map(*[x for t, n in sizes.items() for x in (F.lit(t), F.lit(max(1, n // (PARTS * PER_PART))))])
    key = F.pmod(F.xxhash64(F.lit(turn), "position"), F.element_at(every, F.col("task")))
    # the sample only decides where ranges are cut
    sample = rows.where(key == 0).distinct().limit(4 * PARTS * PER_PART * len(sizes)).collect()
    found = {t: sorted((r["position"] for r in sample if r["task"] == t)) for t in sizes}
    return {t: [s[len(s) * k // PARTS] for k in range(1, PARTS) if s] for t, s in found.items()}


def select_cuts(positions: DataFrame, wanted: dict, gathered=GATHERED) -> dict:
    """{task: position of its row number ``wanted[task]``} of (task, position), for tasks with more rows than that."""
    dtype = positions.schema["position"].dataType
    positions = positions.where(F.col("position").isNotNull() & F.col("task").isin(list(wanted)))
    ends = positions.groupBy("task").agg(F.count("*").alias("n"), F.min("position").alias("low"), F.max("position").alias("high"))
    state = {r["task"]: (r["low"], r["high"], r["n"], wanted[r["task"]]) for r in ends.collect() if r["n"] > wanted[r["task"]]}
    cuts, turn = {}, 0
    while state:
        turn += 1
        small = {t: s for t, s in state.items() if s[2] <= gathered}
        if small:
            rows = _within(positions, {t: s[:2] for t, s in small.items()}, dtype)
            for r in rows.groupBy("task").agg(F.sort_array(F.collect_list("position")).alias("all")).collect():  # ``gathered`` at most
                rank = small[r["task"]][3]
                if rank < len(r["all"]) and r["all"][rank] == r["all"][rank - 1]:
                    raise ValueError(NOT_UNIQUE)
                cuts[r["task"]] = r["all"][rank - 1]
        state = {t: s for t, s in state.items() if t not in small}
        if not state:
            break
        rows = _within(positions, {t: s[:2] for t, s in state.items()}, dtype)
        marks = _splitters(rows, {t: s[2] for t, s in state.items()}, turn)
        # without a sampled position the least one still parts the range
        marks = [(t, marks[t] or [s[0]]) for t, s in state.items()]
        schema = T.StructType([T.StructField("task", T.StringType()), T.StructField("marks", T.ArrayType(dtype))])
        known = F.broadcast(positions.sparkSession.createDataFrame(marks, schema))
        part = F.expr("size(filter(marks, m -> m < position))").alias("part")
        counts = rows.join(known, "task").groupBy("task", part).agg(
            F.count("*").alias("n"), F.min("position").alias("low"), F.max("position").alias("high")
        )
        by_task = {}
        for r in sorted(counts.collect(), key=lambda r: r["part"]):  # PARTS rows a task
            by_task.setdefault(r["task"], []).append(r)
        for task, parts in by_task.items():
            rank = state[task][3]
            for r in parts:
                if rank <= r["n"]:
                    break
                rank -= r["n"]
            state[task] = (r["low"], r["high"], r["n"], rank)
            if r["low"] == r["high"]:
                if rank < r["n"]:
                    raise ValueError(NOT_UNIQUE)
                cuts[task] = r["low"]
                del state[task]
            elif rank == r["n"]:
                # the part's last row, and positions of the next part are larger
                cuts[task] = r["high"]
                del state[task]
    return cuts


def head_n(df: DataFrame, n, order="seq", gathered=GATHERED) -> DataFrame:
    """The n rows with the smallest positions; n of None or 0 keeps every row."""
    if not n:
        return df
    if n > gathered:
        positions = df.select(F.lit("").alias("task"), F.col(order).alias("position"))
        cuts = select_cuts(positions, {"": n}, gathered)
        # rows without a position are none of the first n
        return df.where(F.col(order) <= _literal(cuts[""], df.schema[order].dataType) if cuts else F.col(order).isNotNull())
    spread = df.select(order).withColumn("salt", F.pmod(F.xxhash64(order), F.lit(_salts(df))))
    rank = F.row_number().over(W.partitionBy("salt").orderBy(order))
    nearest = spread.withColumn("rank", rank).where(F.col("rank") <= n + 1).select(order)
    # one more than wanted, to see whether the cut is clear
    first = nearest.orderBy(order).limit(n + 1).withColumn("place", F.row_number().over(W.orderBy(order)))
    ends = first.agg(
        F.max(F.when(F.col("place") <= n, F.col(order))).alias("cut"),
        F.max(F.when(F.col("place") > n, F.col(order))).alias("following"),
    )
    cut = ends.select(_unique(F.col("cut"), F.col("following")).alias("cut"))
    return df.where(F.col(order) <= cut.scalar())


def head_n_per_task(df: DataFrame, caps: dict, order="seq", task="task", keep_others=False, gathered=GATHERED) -> DataFrame:
    """The first ``caps[task]`` rows of every task; a cap of None or 0 keeps all its rows.

    A task that ``caps`` does not name fails the job, or with ``keep_others`` stays whole.
    A task may hold most of the table: up to ``gathered`` rows its positions are ranked per
    salt first, by its own cap; larger caps are selected together, a round for all of them.
    """
    spark = df.sparkSession
    capped = {name: int(cap) for name, cap in caps.items() if cap and cap > 0}
    if not keep_others:
        known = F.col(task).isin([name for name in caps]) if caps else F.lit(False)
        unknown = F.raise_error(F.concat(F.lit("no settings for task "), F.coalesce(task, F.lit("null"))))
        df = df.where(F.when(F.coalesce(known, F.lit(False)), F.lit(True)).otherwise(unknown.cast("boolean")))
    if not capped:
        return df
    dtype, cuts = df.schema[order].dataType, None
    few = {name: cap for name, cap in capped.items() if cap <= gathered}
    many = {name: cap for name, cap in capped.items() if cap > gathered}
    if few:
        table = F.broadcast(spark.createDataFrame(list(few.items()), "cap_task STRING, cap BIGINT"))

        def ranked(rows, *keys):
            rank = F.row_number().over(W.partitionBy(*keys).orderBy(order))
            return rows.withColumn("rank", rank).where(F.col("rank") <= F.col("cap") + 1)

        spread = df.select(task, order).join(table, F.col(task) == F.col("cap_task")).withColumn(
            "salt", F.pmod(F.xxhash64(order), F.lit(_salts(df)))
        )
        nearest = ranked(ranked(spread, task, "salt").drop("rank"), task)
        kept = F.col("rank") <= F.col("cap")
        ends = nearest.groupBy("cap_task").agg(
            F.max(F.when(kept, F.col(order))).alias("cut"), F.max(F.when(~kept, F.col(order))).alias("following")
        )
        cuts = ends.select("cap_task", _unique(F.col("cut"), F.col("following")).alias("_cut"))
    if many:
        found = select_cuts(df.select(F.col(task).alias("task"), F.col(order).alias("position")), many, gathered)
        schema = T.StructType([T.StructField("cap_task", T.StringType()), T.StructField("_cut", dtype)])
        # a task with no more rows than its cap has no cut and stays whole
        capped = few | {name: many[name] for name in found}
        selected = spark.createDataFrame(list(found.items()), schema)
        cuts = selected if cuts is None else cuts.unionAll(selected)
    free = ~F.coalesce(F.col(task).isin(list(capped)), F.lit(False)) if capped else F.lit(True)
    # one row per capped task, and the caps come from the driver
    return df.join(F.broadcast(cuts), F.col(task) == F.col("cap_task"), "left").where(
        free | (F.col(order) <= F.col("_cut"))
    ).select(*[df[c] for c in df.columns])
