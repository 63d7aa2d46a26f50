"""Points in blocks around pivots, and searches that skip the blocks that lie too far.

At most ``PIVOTS`` pivots (a few Lloyd rounds over a bounded sample) cut the space into
cells; the points of a cell, in order of their distance to its pivot, are cut into rings
of ``BLOCK`` points, the blocks.  A query at distance D from a cell's pivot is at least

* D - rmax and rmin - D away from a ring between rmin and rmax (triangle inequality), and
* (D^2 - D0^2) / (2 |p - p0|) away from the cell, D0 being its distance to its own pivot p0
  (the points of a cell lie on their pivot's side of the plane between two pivots),

so a search with a bound visits the blocks whose least distance is within it, and no other.
The bounds hold in any number of dimensions; only how much they skip depends on the data.

Blocks are dealt to spans of at most about ``SPAN_BYTES`` (a few at least).  A visit is a row (query,
span, blocks): a query is sent once to a span, whatever blocks of it there are to see, and leaves
with one result.  Visits and points meet by span, points first; a task holds the points of one
span while its queries stream past.  A span is copied, and its queries are dealt over the copies.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import join_small
from .lineage import cut
from .ordering import RANK, ranked

#: Most pivots, points a pivot where there are fewer, points of a block, queries of one
#: copy of a span beyond ``COPIES``, rows that choose the pivots and rounds of that.
PIVOTS, PER_PIVOT, BLOCK, ASKS, SAMPLE, LLOYD = 256, 64, 1024, 100_000, 4096, 4
#: Bytes of the vectors of a span, least number of spans and of copies of one with more than ``STEP``
#: queries a copy, and rings of a cell that stay together.
SPAN_BYTES, SPANS, COPIES, TOGETHER = 32 << 20, 4, 8, 16
#: Share of a distance by which rounding may move a bound.
SLACK = 1e-9
#: Queries that meet a block at a time.
STEP = 2048


def usable(v: str | Column = "v") -> Column:
    """Vectors without null, NaN or infinite components; others have no distance."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(v, odd), F.lit(False))


def matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def few_copies(points: DataFrame, by: Sequence[str], most: int) -> DataFrame:
    """Of equal vectors of a group only the ``most`` smallest ids; no search for that many
    neighbours can want another."""
    w = Window.partitionBy(*by, "v").orderBy("id")
    return points.withColumn("_copy", F.row_number().over(w)).where(F.col("_copy") <= most).drop("_copy")


def _centres(points: DataFrame, n: int, dims: int) -> np.ndarray:
    """Pivots from at most ``SAMPLE`` different vectors, chosen by hash."""
    share = max(1, n // (4 * SAMPLE))
    h = F.xxhash64("v")
    x = np.array([r["v"] for r in points.where(F.pmod(h, F.lit(share)) == 0).select("v", h.alias("h")).distinct()
                  .orderBy("h").limit(SAMPLE).collect()], float).reshape(-1, dims)
    if not len(x):
        return np.zeros((1, dims))
    k = max(1, min(PIVOTS, n // PER_PIVOT, len(x)))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(LLOYD):
        own = distances(x, c).argmin(1)
        for j in np.unique(own):
            c[j] = x[own == j].mean(0)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(rows, centres), by differences, so that near ones keep their digits."""
    out = np.empty((len(x), len(c)))
    for j, p in enumerate(c):
        d = x - p
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def squared(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances row by row, summed in the order of the components as SQL would."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        d = q[:, j] - p[:, j]
        out += d * d
    return out


class Blocks:
    """``points (by..., id, v, more...)`` in blocks.  Rows whose vector is not usable or whose
    group is null are left out."""

    def __init__(self, points: DataFrame, dims: int, by: Sequence[str] = ()):
        self.dims, self.spark = dims, points.sparkSession
        self.by = list(by) or ["_all"]
        points = points.where(usable()) if by else points.where(usable()).withColumn("_all", F.lit(0))
        points = cut(points.dropna(subset=self.by))
        self.n = points.count()
        self.pivots = _centres(points, self.n, dims)
        self.between = distances(self.pivots, self.pivots)
        pivots = self.pivots

        def place(batches):
            for b in batches:
                d = distances(matrix(b.column("v"), dims), pivots)
                own = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(own)), own])],
                    names=[*b.schema.names, "cell", "dist"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
        placed = cut(points.mapInArrow(place, f"{kinds}, cell int, dist double"))
        placed = ranked(placed, ["dist", "id"], by=[*self.by, "cell"], with_group_size=False) \
            .withColumn("ring", F.floor((F.col(RANK) - 1) / BLOCK)).drop(RANK)
        placed = cut(placed)
        rings = cut(placed.groupBy(*self.by, "cell", "ring").agg(
            F.min("dist").alias("rmin"), F.max("dist").alias("rmax"), F.count(F.lit(1)).alias("n"))
            .withColumn("block", F.monotonically_increasing_id())
            .withColumn("span", F.pmod(F.xxhash64(*self.by, "cell", F.floor(F.col("ring") / TOGETHER)), F.lit(
                max(SPANS, -(-self.n * 8 * dims // SPAN_BYTES)))).cast("int")))
        self.points = cut(placed.join(rings.select(*self.by, "cell", "ring", "block", "span"), [*self.by, "cell", "ring"])
                          .drop("ring"))
        self.rings = rings
        self.rings_of = rings.groupBy(*self.by, "cell", "span").agg(
            F.collect_list(F.struct("rmin", "rmax", "n", "block")).alias("rings"))
        self.cells = cut(rings.groupBy(*self.by, "cell").agg(F.min("rmin").alias("rmin"), F.max("rmax").alias("rmax"),
                                                             F.sum("n").alias("n"))
                         .groupBy(*self.by).agg(F.sort_array(F.collect_list(F.struct("cell", "rmin", "rmax", "n"))).alias("cells")))

    def grouped(self, queries: DataFrame) -> DataFrame:
        """Queries with a usable vector, with the group column that the blocks have."""
        q = queries.where(usable())
        return q.withColumn("_all", F.lit(0)) if self.by == ["_all"] else q

    def marked(self, marks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Points with the ``mark`` (a number from 0) that ``marks (id, mark)`` gives them, and
        cells and rings that know the mark of all their points, or -1 where it is not one."""
        one = F.when(F.min("mark") == F.max("mark"), F.min("mark")).otherwise(F.lit(-1).cast("long")).alias("mark")
        points = cut(self.points.join(marks, "id"))
        rings = cut(self.rings.join(points.groupBy("block").agg(one), "block"))
        cells = rings.groupBy(*self.by, "cell").agg(F.min("rmin").alias("rmin"), F.max("rmax").alias("rmax"),
                                                    F.sum("n").alias("n"), one)
        return points, cut(cells.groupBy(*self.by).agg(F.sort_array(F.collect_list(
            F.struct("cell", "rmin", "rmax", "n", "mark"))).alias("cells"))), \
            rings.groupBy(*self.by, "cell", "span").agg(F.collect_list(F.struct("rmin", "rmax", "n", "block", "mark")).alias("rings"))

    def visits(self, queries: DataFrame, want: int | None = None, cells: DataFrame | None = None,
               rings_of: DataFrame | None = None) -> DataFrame:
        """``(by..., q, span, blocks)`` of ``queries (by..., q, v, bound)`` (from :meth:`grouped`): all
        blocks that may hold a point within ``bound``; or, with ``want``, some near blocks
        that hold so many points, if the group has them (the bound plays no part).  With
        ``cells`` and ``rings_of`` from :meth:`marked`, queries have a ``mark`` too, and
        blocks whose points all bear it are not visited."""
        dims, pivots, between, by = self.dims, self.pivots, self.between, self.by
        mark = [] if cells is None else ["mark"]
        asked = join_small(queries.select(*by, "q", "v", "bound", *mark), self.cells if cells is None else cells, by)

        def choose(batches):
            for b in batches:
                d = distances(matrix(b.column("v"), dims), pivots)
                lists = b.column("cells")
                at = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(len(at)), at)
                inside = lists.flatten()
                cell, rmin, rmax, n = (inside.field(c).to_numpy(zero_copy_only=False) for c in ("cell", "rmin", "rmax", "n"))
                near = d.argmin(1)
                to = d[row, cell]
                span = between[cell, near[row]]
                plane = np.divide(to ** 2 - d[row, near[row]] ** 2, 2 * span, out=np.zeros(len(row)), where=span > 0)
                least = np.maximum.reduce([np.zeros(len(row)), to - rmax, rmin - to, plane])
                some = np.arange(len(row))
                if mark:
                    some = np.flatnonzero(inside.field("mark").to_numpy() != b.column("mark").to_numpy()[row])
                if want is None:
                    bound = b.column("bound").to_numpy(zero_copy_only=False)[row]
                    take = some[(least <= bound + SLACK * (to + rmax))[some]]
                else:
                    order = some[np.lexsort((to[some], least[some], row[some]))]
                    held = np.cumsum(n[order])
                    first = np.searchsorted(row[order], np.arange(len(at)))
                    before = held - n[order]
                    take = order[before - before[np.minimum(first, len(order) - 1)][row[order]] < want] if len(order) else order
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).take(pa.array(row[take])) for c in (*by, "q", "bound", *mark)],
                     pa.array(cell[take]), pa.array(to[take])], names=[*by, "q", "bound", *[f"own_{c}" for c in mark], "cell", "to"])

        kinds = ", ".join(f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in (*by, "q"))
        near = join_small(asked.mapInArrow(choose, f"{kinds}, bound double, {'own_mark long, ' if mark else ''}cell int, to double"),
                          self.rings_of if rings_of is None else rings_of, [*by, "cell"])
        if mark:
            near = near.withColumn("rings", F.filter("rings", lambda r: r["mark"] != F.col("own_mark")))
        gap = lambda r: F.greatest(F.lit(0.0), r["rmin"] - F.col("to"), F.col("to") - r["rmax"])
        if want is None:
            slack = lambda r: F.lit(SLACK) * (F.col("to") + r["rmax"])
            rings = F.transform(F.filter("rings", lambda r: gap(r) <= F.col("bound") + slack(r)), lambda r: r["block"])
        else:  # two rings of a cell's span hold a whole block, or all of it
            rings = F.transform(F.slice(F.array_sort(F.transform("rings", lambda r: F.struct(gap(r).alias("g"), r["block"].alias("block")))),
                                        1, 2), lambda r: r["block"])
        return near.select(*by, "q", "span", rings.alias("blocks")).where(F.size("blocks") > 0) \
            .mapInArrow(_packed([*by, "q"]), f"{kinds}, span int, blocks array<long>")

    def meet(self, visits: DataFrame, queries: DataFrame, compare: Callable, schema: str,
             points: DataFrame | None = None, most: int = 1, order: Sequence[str] = ("w", "b")) -> DataFrame:
        """Runs ``compare(queries, points)`` for the queries of every visited block, both as Arrow
        tables with all their columns (the queries' in steps; ``at``: their place among them), and
        unites what it yields: of a query and the blocks of a span the ``most`` first rows in ``order``.
        ``compare`` yields the places of the queries too, as ``at``."""
        by = self.by
        copies = visits.groupBy("span").agg(F.count(F.lit(1)).alias("asks")).select("span", F.greatest(
            F.ceil(F.col("asks") / ASKS), F.least(F.lit(COPIES), F.ceil(F.col("asks") / STEP))).cast("int").alias("copies"))
        copies = cut(copies)
        points = self.points if points is None else points
        held = points.drop(*by, "cell", "dist").join(F.broadcast(copies), "span") \
            .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        asks = visits.join(queries, [*by, "q"]).join(F.broadcast(copies), "span") \
            .withColumn("copy", F.pmod(F.xxhash64("q"), F.col("copies")).cast("int")).drop("copies")
        mine = [c for c in held.columns if c not in ("span", "copy")]
        theirs = [c for c in asks.columns if c not in ("span", "copy")]
        # vectors that a row has not are empty: Arrow batches take long to size with null ones
        none = lambda df, names, letter: [F.array().cast(df.schema[c].dataType).alias(f"{letter}_{c}")
                                          for c in names if isinstance(df.schema[c].dataType, T.ArrayType)]
        both = held.select("span", "copy", F.lit(0).alias("kind"), *[F.col(c).alias(f"p_{c}") for c in mine], *none(asks, theirs, "q")) \
            .unionByName(asks.select("span", "copy", F.lit(1).alias("kind"), *[F.col(c).alias(f"q_{c}") for c in theirs],
                                     *none(held, mine, "p")), allowMissingColumns=True)
        dealt = both.repartition("span", "copy").sortWithinPartitions("span", "copy", "kind", "p_block", "p_id")
        names = both.columns

        def seen(ask, blocks):
            """What some queries find in their blocks."""
            lists = ask.column("q_blocks")
            row = np.repeat(np.arange(ask.num_rows), np.diff(lists.offsets.to_numpy()))
            block = lists.flatten().to_numpy(zero_copy_only=False)
            turn = np.argsort(block, kind="stable")
            row, block = row[turn], block[turn]
            ask = ask.select([f"q_{c}" for c in theirs if c != "blocks"]).rename_columns([c for c in theirs if c != "blocks"])
            ask = ask.append_column("at", pa.array(np.arange(ask.num_rows)))
            found = []
            edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
            for lo, hi in zip(edges[:-1], edges[1:]):
                if block[lo] in blocks:
                    whole = hi - lo == ask.num_rows and (np.diff(row[lo:hi]) == 1).all()
                    found += compare(ask if whole else ask.take(pa.array(row[lo:hi])), blocks[block[lo]])
            if not found:
                return
            t = pa.Table.from_batches(found)
            t = t.take(pc.sort_indices(t, [(c, "ascending") for c in ("at", *order)], null_placement="at_start"))
            at = t.column("at").to_numpy()
            t = t.filter(pa.array(np.arange(len(at)) - np.searchsorted(at, at) < most)).drop_columns("at")
            yield from t.combine_chunks().to_batches()

        def run(batches):
            at, parts, blocks = None, [], None
            for b in batches:
                if not b.num_rows:
                    continue
                span, copy, kind = (b.column(c).to_numpy() for c in ("span", "copy", "kind"))
                turn = (np.diff(span) != 0) | (np.diff(copy) != 0) | (np.diff(kind) != 0)
                edges = [0, *(np.flatnonzero(turn) + 1), len(span)]
                for lo, hi in zip(edges[:-1], edges[1:]):
                    here = (span[lo], copy[lo])
                    if kind[lo] == 0:
                        if at != here:
                            at, parts = here, []
                        parts.append(b.slice(lo, hi - lo).select([f"p_{c}" for c in mine]))
                        blocks = None
                    elif at == here:
                        if blocks is None:
                            whole = pa.Table.from_batches(parts).combine_chunks().rename_columns(mine)
                            parts = []
                            own = whole.column("block").to_numpy()
                            cuts = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
                            blocks = {own[i]: whole.slice(i, j - i) for i, j in zip(cuts[:-1], cuts[1:])}
                        for i in range(lo, hi, STEP):
                            yield from seen(b.slice(i, min(STEP, hi - i)), blocks)

        assert names[:3] == ["span", "copy", "kind"]
        return dealt.mapInArrow(run, schema)


def _packed(keys: Sequence[str]):
    """Rows ``(keys..., span, blocks)`` → one for each run of equal keys and each span in a batch."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            same = np.zeros(b.num_rows - 1, bool)
            for c in keys:
                code = b.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                same |= np.diff(code) != 0
            of = np.concatenate([[0], np.cumsum(same)])
            span, lists = b.column("span").to_numpy(), b.column("blocks")
            sizes = np.diff(lists.offsets.to_numpy())
            order = np.lexsort((span, of))
            first = np.flatnonzero(np.concatenate([[True], (np.diff(of[order]) != 0) | (np.diff(span[order]) != 0)]))
            ends = np.concatenate([[0], np.cumsum(sizes[order])])
            begin = (np.cumsum(sizes) - sizes)[order]
            spot = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], sizes[order])
            flat = lists.flatten().to_numpy(zero_copy_only=False)[spot]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c).take(pa.array(order[first])) for c in keys], pa.array(span[order[first]]),
                 pa.ListArray.from_arrays(pa.array(np.append(ends[first], ends[-1]).astype(np.int32)), pa.array(flat))],
                names=[*keys, "span", "blocks"])
    return run


def column_matrix(table, name: str, dims: int) -> np.ndarray:
    c = table.column(name)
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
        if isinstance(c, pa.ChunkedArray):
            c = c.chunk(0)
    return matrix(c, dims)


def near_pairs(q: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of p, squared distance) of the k nearest of each row, ties by row of p."""
    k = min(k, len(p))
    qq, pp = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", p, p)
    rough = qq[:, None] + pp[None, :] - 2 * (q @ p.T)
    kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
    # within rounding of the k-th: measured again by differences
    i, j = np.nonzero(rough <= (kth + 1e-12 * (q.shape[1] + 4) * (qq + pp.max()))[:, None])
    d2 = squared(q[i], p[j])
    order = np.lexsort((j, d2, i))
    i, j, d2 = i[order], j[order], d2[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], d2[place < k]


def nearest(queries: DataFrame, points: DataFrame, key: str, feats: Sequence[str], k: int, by: Sequence[str] = (),
            include_self: bool = False) -> tuple[DataFrame, DataFrame, "Blocks"]:
    """Exact k nearest points of every query → ``(by..., q, p, d2, nn_rank)`` (ties by key),
    the visits ``(by..., q, span, blocks)`` that found them, and the blocks.

    One search of a few near blocks bounds the k-th distance of every query; a second one
    visits every block within that bound."""
    feats, by = list(feats), list(by)
    vector = F.array(*[F.col(f).cast("double") for f in feats]).alias("v")
    want = k if include_self else k + 1
    pts = few_copies(points.select(*by, F.col(key).alias("id"), vector).where(usable()), by, want)
    blocks = Blocks(pts, len(feats), by)
    asked = cut(blocks.grouped(queries.select(*by, F.col(key).alias("q"), vector)))
    dims, cols = len(feats), blocks.by

    def compare(q, p):
        i, j, d2 = near_pairs(column_matrix(q, "v", dims), column_matrix(p, "v", dims), want)
        ids = p.column("id")
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        yield pa.RecordBatch.from_arrays(
            [*[q.column(c).take(pa.array(i)) for c in cols], q.column("q").take(pa.array(i)),
             ids.chunk(0).take(pa.array(j)) if isinstance(ids, pa.ChunkedArray) else ids.take(pa.array(j)), pa.array(d2),
             q.column("at").take(pa.array(i))], names=[*cols, "q", "p", "d2", "at"])

    kinds = [*[(c, asked.schema[c].dataType.simpleString()) for c in cols], ("q", asked.schema["q"].dataType.simpleString()),
             ("p", points.schema[key].dataType.simpleString()), ("d2", "double")]
    schema = ", ".join(f"`{c}` {t}" for c, t in kinds)
    first = cut(blocks.visits(asked.withColumn("bound", F.lit(0.0)), want))
    bounds = blocks.meet(first, asked, compare, schema, most=want, order=["d2", "p"]).groupBy(*cols, "q").agg(
        F.sqrt(F.get(F.sort_array(F.collect_list("d2")), F.lit(want - 1))).alias("bound"))
    bounded = cut(asked.join(bounds, [*cols, "q"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))))
    second = cut(blocks.visits(bounded))
    found = blocks.meet(second, asked, compare, schema, most=want, order=["d2", "p"])
    if not include_self:
        found = found.where(F.col("q") != F.col("p"))
    w = Window.partitionBy(*cols, "q").orderBy("d2", "p")
    top = cut(found.withColumn("nn_rank", F.row_number().over(w)).where(F.col("nn_rank") <= k)
              .select(*by, "q", "p", "d2", "nn_rank"))
    return top, second, blocks


def compared(visits: DataFrame, blocks: "Blocks") -> int:
    """Pairs (query, point) that some visits compare."""
    return visits.select(F.explode("blocks").alias("block")).join(blocks.rings.select("block", "n"), "block").agg(F.sum("n")).first()[0] or 0
