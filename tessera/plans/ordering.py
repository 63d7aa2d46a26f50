"""Skew-safe ranking and exact order statistics.

A ``Window.partitionBy(group)`` puts a whole group into one task, and a window
without a partition puts the whole table into one task.  Neither survives a
group holding a third of a 100 TB table.  The helpers here rank rows with a
range shuffle instead:

1. ``repartitionByRange(group..., order...)`` cuts the sorted key space into
   balanced partitions (a hot group is split across many of them);
2. each partition is sorted locally and numbered with its local position;
3. a tiny table of (partition, group) counts is prefix-summed per group;
4. rank = rows of the group in earlier partitions + local position.

Step 3 has at most ``partitions + groups`` rows; it is joined back with a
broadcast only when its measured size is below the bound.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import join_small
from .lineage import cut

RANK = "_rank"


GROUP_N = "_group_n"


def _as_cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def default_partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def _sort_key(t):
    return tuple((v is not None, v) for v in t)


# Boundaries whose search is one nested CASE.
SPELLED_OUT = 64


def _plain(key: Column, kind: T.DataType) -> Column:
    """``key`` as a number or string that sorts alike and survives JSON unchanged."""
    if isinstance(kind, T.DateType):
        return F.unix_date(key)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(key)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), key)
    if isinstance(kind, T.BinaryType):
        return F.hex(key)
    return key


def range_bucket(df: DataFrame, keys: Sequence, num_buckets: int | None = None,
                 per_bucket_sample: int = 64, seed: int = 17) -> tuple[Column, int]:
    """A deterministic bucket column, monotone in the ``keys`` tuple.

    Boundaries are picked once on the driver from a small sample of the key
    tuples (at most ``num_buckets × per_bucket_sample`` rows), and the bucket
    is assigned by a binary search of ``struct`` comparisons against those
    literal boundaries.  Unlike ``spark_partition_id()`` after a range
    shuffle, the bucket is a pure function of the row, so every branch of a
    plan (counts, data, retries after executor loss) agrees on it.  A hot key
    value is split as long as the trailing keys (e.g. a unique id) differ.
    """
    keys = _as_cols(keys)
    parts = num_buckets or default_partitions(df)
    n = df.count()
    if n == 0 or parts <= 1:
        return F.lit(0), 1
    names = [f"_k{i}" for i in range(len(keys))]
    keys = [_plain(k, f.dataType) for k, f in zip(keys, df.select(*keys).schema.fields)]
    frac = min(1.0, parts * per_bucket_sample / n)
    sample = df.select(*[k.alias(nm) for k, nm in zip(keys, names)])
    if frac < 1.0:
        sample = sample.sample(fraction=frac, seed=seed)
    pts = sorted((tuple(r) for r in sample.collect()), key=_sort_key)
    if not pts:
        return F.lit(0), 1
    bounds = []
    for i in range(1, parts):
        b = pts[min(len(pts) - 1, (i * len(pts)) // parts)]
        if not bounds or _sort_key(b) > _sort_key(bounds[-1]):
            bounds.append(b)
    if not bounds:
        return F.lit(0), 1
    row = F.struct(*[k.alias(nm) for k, nm in zip(keys, names)])
    # one literal, whatever the number of boundaries
    table = F.from_json(F.lit(json.dumps([dict(zip(names, b)) for b in bounds], default=str)),
                        T.ArrayType(sample.schema))
    # bucket = number of boundaries ≤ row, by halving: spelled out while that is short
    # (it compiles), by a fold over the literal beyond
    if len(bounds) <= SPELLED_OUT:
        def search(lo, hi):
            if lo >= hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(row >= F.get(table, F.lit(mid)), search(mid + 1, hi)).otherwise(search(lo, mid))

        return search(0, len(bounds)), len(bounds) + 1
    steps = max(1, math.ceil(math.log2(len(bounds) + 1)))

    def halve(at, _):
        mid = F.shiftright(at["lo"] + at["hi"], 1)
        right = (at["lo"] < at["hi"]) & (row >= F.get(table, mid))
        return F.struct(F.when(right, mid + 1).otherwise(at["lo"]).alias("lo"),
                        F.when(right, at["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda at: at["lo"]), len(bounds) + 1


def ranked(df: DataFrame, order: Sequence, by: Sequence[str] = (),
           num_partitions: int | None = None, with_group_size: bool = True,
           max_groups: int | None = None, hashed: bool = False) -> DataFrame:
    """Add ``_rank`` (1-based row number in ``order``) within each ``by`` group,
    and ``_group_n`` (rows in the group).

    ``order`` should be a total order (end it with a unique key) so that the
    result is repeatable.  Rows go to deterministic range buckets of
    ``(by, order)``; a window numbers rows inside each (bucket, group) — a
    bounded partition even when one group holds a third of the table — and a
    small (bucket, group) count table supplies each bucket's offset.
    ``max_groups`` (a proven bound on distinct ``by`` values) sizes that table
    without a job: it has at most ``buckets + groups`` rows.  ``hashed``: the first column of
    ``order`` is a 64-bit hash; its leading bits are the bucket, without a sample or a search.
    """
    by = list(by)
    order_cols = _as_cols(order)
    if hashed:
        bits = max(1, ((num_partitions or default_partitions(df)) - 1).bit_length())
        bucket, nb = F.shiftright(order_cols[0], 64 - bits), 1 << bits
    else:
        bucket, nb = range_bucket(df, [F.col(b) for b in by] + order_cols, num_partitions)
    d = df.withColumn("_b", bucket)
    counts = d.groupBy("_b", *by).agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*by).orderBy("_b") if by else Window.orderBy("_b")
    counts = counts.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    if with_group_size:
        wg = Window.partitionBy(*by) if by else Window.partitionBy()
        counts = counts.withColumn(GROUP_N, F.sum("_cnt").over(wg))
    counts = counts.drop("_cnt")
    lw = Window.partitionBy("_b", *by).orderBy(*order_cols)
    local = d.withColumn("_local", F.row_number().over(lw))
    bound = nb if not by else None if max_groups is None else nb * max_groups if hashed else nb + max_groups
    out = join_small(local, counts, on=["_b", *by], how="inner", known_rows=bound)
    out = out.withColumn(RANK, (F.col("_off") + F.col("_local")).cast("long"))
    return out.drop("_b", "_local", "_off")


def long_values(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (),
                value_type: str = "double") -> DataFrame:
    """Wide → long: one row per (row, column) with ``column`` and ``value``."""
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast(value_type).alias("value"))
                    for c in cols])
    return df.select(*keep, F.inline(arr))


def _target_ranks(n: int, q: float, interpolation: str) -> tuple[int, int, float]:
    """1-based ranks (lo, hi) and interpolation weight for quantile ``q`` of n."""
    pos = (n - 1) * q
    if interpolation == "nearest":
        r = int(math.floor(pos + 0.5)) + 1  # half away from zero (pos ≥ 0)
        return r, r, 0.0
    lo = int(math.floor(pos))
    return lo + 1, min(int(math.ceil(pos)), n - 1) + 1, pos - lo


# Rows we accept inside one bracket before collecting its distinct values.
BRACKET_LIMIT = 20_000
# Rows of a bracket that are collected without a sketch.
SMALL_BRACKET = 2_000
# Accuracy of the sketch that narrows a bracket: its ranks err by at most n / SKETCH.
SKETCH = 10_000
# Ranks of a group beyond which all are looked up in one sorted pass.
MANY_RANKS = 50


def _indexed(lv: DataFrame, groups: list, by_col: str) -> DataFrame:
    """``(_g, value)``: the number of the row's group in ``groups``; others are left out."""
    if groups == list(range(len(groups))) and lv.schema[by_col].dataType.typeName() in ("integer", "long"):
        return lv.select(F.col(by_col).cast("int").alias("_g"), "value")
    place = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col(by_col)).cast("int") - 1
    return lv.select(place.alias("_g"), "value").where(F.col("_g") >= 0)


def exact_ranks(lv: DataFrame, wants: dict, by_col: str = "column_name",
                limit: int = BRACKET_LIMIT, accuracy: int = SKETCH) -> dict:
    """Exact value at given 1-based ranks of ``value`` within each ``by_col`` group.

    ``wants``: ``{group: (n, [rank, ...])}`` (nulls already removed).
    Distributed selection without sorting, by rank and so indifferent to the
    values' scale: a mergeable sketch of the open bracket of each wanted rank
    names two values around it, one aggregate counts exactly what lies below,
    at and between them, and the rank is at one of them or in the new, open
    bracket, which holds at most about 8 / ``accuracy`` of the rows.  When a
    bracket holds ≤ ``limit`` rows its distinct values (with counts) are
    collected.  At most ``limit`` rows per wanted rank ever reach the driver.
    A row looks up the brackets of its own group only, so the work of a row does
    not grow with the number of groups.
    """
    groups = sorted(wants, key=str) if not all(isinstance(g, int) for g in wants) else sorted(wants)
    if groups and all(isinstance(g, int) for g in groups):
        groups = list(range(groups[-1] + 1))
    rows = _indexed(lv, groups, by_col)
    v = F.col("value")
    result: dict = {}
    # open brackets: (group, low, high, rows below, rows inside, ranks)
    todo = [(grp, None, None, 0, n, sorted(ranks)) for grp, (n, ranks) in wants.items()]

    def numbered(brackets):
        """``(_b, value)`` of the rows inside a bracket."""
        own: list = [[] for _ in groups]
        for i, b in enumerate(brackets):
            own[groups.index(b[0])].append({"low": b[1], "high": b[2], "b": i})
        if all(len(o) <= 1 and all(x["low"] is None and x["high"] is None for x in o) for o in own):
            place = F.get(F.from_json(F.lit(json.dumps([o[0]["b"] if o else None for o in own])), "array<int>"), F.col("_g"))
        else:
            table = F.from_json(F.lit(json.dumps(own)), "array<array<struct<low:double,high:double,b:int>>>",
                                {"allowNonNumericNumbers": "true"})
            inside = F.filter(F.get(table, F.col("_g")), lambda x: (x["low"].isNull() | (v > x["low"])) & (x["high"].isNull() | (v < x["high"])))
            place = F.get(inside, F.lit(0))["b"]
        return rows.select(place.alias("_b"), "value").where(F.col("_b").isNotNull())

    def zone(edges):
        """4 zones per interval — below a, at a, between, at b (equal ends: at a is skipped)."""
        table = F.from_json(F.lit(json.dumps(edges)), "array<array<double>>", {"allowNonNumericNumbers": "true"})
        return F.aggregate(F.get(table, F.col("_b")), F.lit(0), lambda s, e: s + (v >= e).cast("int") + (v > e).cast("int"))

    def settle(values, b):
        """Ranks of a bracket from its distinct values and their counts."""
        acc, at = b[3], {}
        for value, c in sorted(values):
            for r in b[5]:
                if acc < r <= acc + c:
                    at[r] = value
            acc += c
        result.update({(b[0], r): at.get(r) for r in b[5]})

    small = min(limit, SMALL_BRACKET)
    while any(b[4] > small for b in todo):
        big = [b for b in todo if b[4] > small]
        todo = [b for b in todo if b[4] <= small]
        probs: list[float] = []
        spans = []  # for each bracket and rank the positions of its two probes
        for _, _, _, below, n, ranks in big:
            slack = 2 * n / accuracy + 1
            spans.append([])
            for r in ranks:
                at = [min(1.0, max(0.0, (r - below + d * slack) / n)) for d in (-1, 1)]
                for p in at:
                    if p not in probs:
                        probs.append(p)
                spans[-1].append((r, probs.index(at[0]), probs.index(at[1])))
        sketch = {r["_b"]: r["_q"] for r in numbered(big).groupBy("_b").agg(
            F.percentile_approx("value", F.array(*[F.lit(p) for p in probs]), accuracy)
            .alias("_q")).collect()}
        cuts = []  # disjoint [a, b] per bracket with their ranks
        for i, span in enumerate(spans):
            merged: list = []
            for r, k, m in span:
                lo, hi = sketch[i][k], sketch[i][m]
                if merged and lo <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(hi, merged[-1][1]), merged[-1][2] + [r])
                else:
                    merged.append((lo, hi, [r]))
            cuts.append(merged)
        edges = [[x for lo, hi, _ in c for x in (lo, hi)] for c in cuts]
        placed = numbered(big).select("_b", zone(edges).alias("_z"), "value")
        # an interval of one rank holds at most 8 n / accuracy rows between its ends: where
        # that is few, its values come with the counts
        few = all(8 * b[4] / accuracy + 8 <= limit for b in big)
        between = F.when((F.col("_z") % 4 == 2) & F.lit(few), v)
        counts: dict = {}
        values: dict = {}
        for r in placed.groupBy("_b", "_z", between.alias("value")).agg(F.count(F.lit(1)).alias("_c")).collect():
            counts[(r["_b"], r["_z"])] = counts.get((r["_b"], r["_z"]), 0) + r["_c"]
            values.setdefault((r["_b"], r["_z"]), []).append((r["value"], r["_c"]))
        for i, (grp, low, high, below, n, ranks) in enumerate(big):
            width = 2 * len(edges[i])
            acc = [below]
            for z in range(width + 1):
                acc.append(acc[-1] + counts.get((i, z), 0))
            opened: dict = {}
            for r in ranks:
                z = next(z for z in range(width + 1) if acc[z + 1] >= r)
                if z % 2:                     # at a probe
                    result[(grp, r)] = edges[i][(z - 1) // 2]
                elif z and edges[i][z // 2 - 1] == (edges[i][z // 2] if z < width else None):
                    result[(grp, r)] = edges[i][z // 2]
                else:
                    opened.setdefault(z, []).append(r)
            for z, rs in opened.items():
                lo = edges[i][z // 2 - 1] if z else low
                hi = edges[i][z // 2] if z < width else high
                b = (grp, lo, hi, acc[z], acc[z + 1] - acc[z], rs)
                if few and z % 4 == 2:
                    settle(values[(i, z)], b)
                else:
                    todo.append(b)
    if todo:
        vals: dict = {}
        for r in numbered(todo).groupBy("_b", "value").agg(F.count(F.lit(1)).alias("_c")).collect():
            vals.setdefault(r["_b"], []).append((r["value"], r["_c"]))
        for i, b in enumerate(todo):
            settle(vals.get(i, []), b)
    return result


def many_ranks(lv: DataFrame, wants: dict) -> dict:
    """``exact_ranks`` for hundreds of ranks of groups ``column_name`` (numbers from 0): equal
    values are counted together, running totals are taken over sorted buckets of
    (group, value), and only the rows that hold a wanted rank are collected."""
    spark = lv.sparkSession
    counted = cut(lv.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("c")))
    running = prefix_sums(counted, ["column_name", "value"], ["c"])
    before, start = {}, 0
    for g in sorted(wants):
        before[g] = start
        start += wants[g][0]
    asked = {g: np.array(sorted(r), np.int64) + before[g] for g, (_, r) in wants.items()}
    shared = spark.sparkContext.broadcast(asked)   # as many numbers as are wanted

    def run(batches):
        for b in batches:
            g, cum, c = (b.column(k).to_numpy() for k in ("column_name", "cum_c", "c"))
            for one in np.unique(g):
                ranks = shared.value.get(int(one), np.zeros(0, np.int64))
                here = np.flatnonzero(g == one)
                lo, hi = np.searchsorted(ranks, cum[here] - c[here], "right"), np.searchsorted(ranks, cum[here], "right")
                n = hi - lo
                at = np.repeat(here, n)
                which = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield pa.RecordBatch.from_arrays([b.column("column_name").take(pa.array(at)), pa.array(ranks[which]),
                                                  b.column("value").take(pa.array(at))], names=["g", "r", "value"])

    found = running.select("column_name", "value", "c", "cum_c").mapInArrow(run, "g int, r long, value double")
    return {(r["g"], r["r"] - before[r["g"]]): r["value"] for r in found.collect()}


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
              interpolation: str = "linear", approx: bool = False,
              accuracy: int = 10000) -> DataFrame:
    """Exact quantiles of many numeric columns: a few without sorting the data
    (:func:`exact_ranks`), many by one sorted pass (:func:`many_ranks`).

    Returns long form ``(column_name, prob, value)``.  ``interpolation`` is
    ``linear`` (pandas / Spark ``percentile`` / DuckDB ``quantile_cont``) or
    ``nearest`` (element at ``round((n-1)·q)``, half away from zero).  Nulls and
    NaN are ignored.  ``approx=True`` returns the mergeable sketch directly.
    """
    spark = df.sparkSession
    probs = [float(p) for p in probs]
    cols = list(cols)
    schema = "column_name string, prob double, value double"
    if approx:
        lv = long_values(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
        pa_ = F.percentile_approx("value", F.array(*[F.lit(p) for p in probs]), accuracy)
        agg = lv.groupBy("column_name").agg(pa_.alias("_q"))
        return agg.select("column_name", F.posexplode("_q").alias("_i", "value")).select(
            "column_name", F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1)
            .alias("prob"), "value")
    if not cols:
        return spark.createDataFrame([], schema)
    x = [F.col(c).cast("double") for c in cols]
    valid = df.agg(*[F.count_if(v.isNotNull() & ~F.isnan(v)).alias(f"n{i}") for i, v in enumerate(x)]).first()
    plan = {}
    wants: dict = {}
    for i in range(len(cols)):
        n = valid[i]
        if not n:
            continue
        for p in probs:
            lo, hi, frac = _target_ranks(n, p, interpolation)
            plan[(i, p)] = (lo, hi, frac)
            wants.setdefault(i, (n, set()))[1].update({lo, hi})
    # columns by number: a row finds its brackets by place
    lv = df.select(F.posexplode(F.array(*x)).alias("column_name", "value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    find = many_ranks if len(probs) > MANY_RANKS else exact_ranks
    got = find(lv, {g: (n, sorted(rs)) for g, (n, rs) in wants.items()}) if wants else {}
    out = []
    for i, c in enumerate(cols):
        for p in probs:
            if (i, p) not in plan:
                out.append((c, p, None))
                continue
            lo, hi, frac = plan[(i, p)]
            a, b = got[(i, lo)], got[(i, hi)]
            out.append((c, p, a + (b - a) * frac if frac else a))
    return spark.createDataFrame(out, schema)


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                   interpolation: str = "linear", approx: bool = False) -> dict:
    """Collect ``{column: {prob: value}}`` (bounded: columns × probs rows)."""
    out: dict = {c: {} for c in cols}
    if not cols:
        return out
    for row in quantiles(df, cols, probs, interpolation, approx=approx).collect():
        out[row["column_name"]][round(row["prob"], 12)] = row["value"]
    return out


def prefix_sums(df: DataFrame, order: Sequence, cols: Sequence[str], descending: bool = False,
                num_partitions: int | None = None) -> DataFrame:
    """Running totals ``cum_<col>`` of ``cols`` in ``order`` over the whole table
    (inclusive of the current row), without an unpartitioned window.

    Deterministic range buckets → per-bucket totals (one row per bucket)
    prefix-summed on a tiny table → running sums inside each bucket → plus the
    bucket's offset.  ``order`` should be unique (ties are summed in an
    arbitrary but consistent order).
    """
    ocols = _as_cols(order)
    bucket, nb = range_bucket(df, ocols, num_partitions)
    if descending:
        bucket = F.lit(nb - 1) - bucket
    d = df.withColumn("_b", bucket)
    okeys = [c.desc() for c in ocols] if descending else ocols
    tot = d.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_b", *[F.coalesce(F.sum(f"_t_{c}").over(w), F.lit(0)).alias(f"_o_{c}")
                             for c in cols])
    lw = Window.partitionBy("_b").orderBy(*okeys).rowsBetween(Window.unboundedPreceding, 0)
    local = d.select("*", *[F.sum(c).over(lw).alias(f"_l_{c}") for c in cols])
    out = join_small(local, off, on="_b", how="inner", known_rows=nb)
    return out.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(f"cum_{c}")
                                     for c in cols])
