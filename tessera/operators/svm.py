"""Support vector machines: hinge and epsilon-insensitive losses, kernels, probabilities.

The objective is |w|^2 / 2 + C * sum of losses, with a free intercept.  Both losses are
piecewise linear; their corners are rounded over a width that shrinks step by step, and
each rounded objective is solved by Newton steps.  One step is one pass: every task adds
up value, gradient and second derivatives of its rows as matrix products, and the sums
meet in Spark by parts.  The machines of all classes and folds share these passes.  Only
these sums (their size is that of the kernel map, squared) reach the driver.

Kernels are finite maps written as SQL over the input columns, so a fitted machine is a
``PipelineModel`` of SQL stages that can be saved and runs on streams:

* ``linear``: the inputs;
* ``poly``: (gamma * x.y)^degree, by its weighted monomials (exact) while they are at most
  ``MAP`` columns, by products of random sign projections beyond;
* ``rbf``: exp(-gamma |x - y|^2), by random Fourier features.

gamma ``scale`` is 1 / (inputs * variance of all their values), ``auto`` 1 / inputs.

Probabilities are Platt's: margins of rows that a fold's machine did not see, and a
sigmoid fitted to them, one for each class and divided by their sum if there are several.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a kernel map, folds of the probabilities, widths of the rounded corners.
MAP, FOLDS = 200, 5
WIDTHS = (2.0, 0.3, 0.05, 8e-3, 1e-3)
#: Newton steps of one width, halvings of a step, doubles in one part of the sums, bytes of a block of rows.
STEPS, HALVINGS, PART, BLOCK = 12, 8, 8192, 1 << 19


def resolve_gamma(df: DataFrame, inputs: Sequence[Column], gamma) -> float:
    """``scale``, ``auto`` or a number."""
    if isinstance(gamma, (int, float)):
        return float(gamma)
    if gamma == "auto":
        return 1.0 / len(inputs)
    if gamma not in (None, "scale"):
        raise ValueError(f"unknown gamma {gamma!r}")
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(inputs)],
               *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(inputs)]).first()
    n, d = r["n"], len(inputs)
    if not n:
        return 1.0 / d
    means = [(r[f"s{i}"] or 0.0) / n for i in range(d)]
    centre = sum(means) / d
    var = sum((r[f"v{i}"] or 0.0) + (m - centre) ** 2 for i, m in enumerate(means)) / d
    return 1.0 / (d * var) if var > 0 else 1.0 / d


def _linear(weights, names: Sequence[str], constant: float = 0.0) -> str:
    terms = [f"({float(w)!r}D) * `{c}`" for w, c in zip(weights, names) if w]
    return " + ".join([f"({float(constant)!r}D)"] + terms)


def kernel_map(names: Sequence[str], kernel: str, gamma: float = 1.0, degree: int = 3, seed: int = 42,
               size: int = MAP) -> list[str]:
    """SQL expressions whose products are those of the kernel, exactly or nearly so."""
    d = len(names)
    if kernel == "linear":
        return [f"`{c}`" for c in names]
    r = np.random.default_rng(seed)
    if kernel == "rbf":
        w, b = r.normal(0.0, math.sqrt(2 * gamma), (size, d)), r.uniform(0, 2 * math.pi, size)
        return [f"({math.sqrt(2.0 / size)!r}D) * cos({_linear(w[k], names, b[k])})" for k in range(size)]
    if kernel != "poly":
        raise ValueError(f"unknown kernel {kernel!r}")
    degree = int(degree)
    if degree < 1:
        raise ValueError("degree must be at least 1")
    if math.comb(d + degree - 1, degree) <= size:
        out = []
        for combo in itertools.combinations_with_replacement(range(d), degree):
            ways = math.factorial(degree) / math.prod(math.factorial(combo.count(i)) for i in set(combo))
            out.append(f"({math.sqrt(ways * gamma ** degree)!r}D) * " + " * ".join(f"`{names[i]}`" for i in combo))
        return out
    out = []
    for _ in range(size):
        signs = r.choice([-1.0, 1.0], (degree, d))
        out.append(f"({math.sqrt(gamma ** degree / size)!r}D) * " + " * ".join(f"({_linear(s, names)})" for s in signs))
    return out


def kernel_points(x: np.ndarray, kernel: str, gamma: float = 1.0, degree: int = 3, seed: int = 42, size: int = MAP) -> np.ndarray:
    """``kernel_map`` of the rows of ``x``, for tasks that hold inputs and not their map."""
    d = x.shape[1]
    if kernel == "linear":
        return x
    r = np.random.default_rng(seed)
    if kernel == "rbf":
        w, b = r.normal(0.0, math.sqrt(2 * gamma), (size, d)), r.uniform(0, 2 * math.pi, size)
        return math.sqrt(2.0 / size) * np.cos(x @ w.T + b)
    degree = int(degree)
    if math.comb(d + degree - 1, degree) <= size:
        out = []
        for combo in itertools.combinations_with_replacement(range(d), degree):
            ways = math.factorial(degree) / math.prod(math.factorial(combo.count(i)) for i in set(combo))
            out.append(math.sqrt(ways * gamma ** degree) * x[:, combo].prod(1))
        return np.stack(out, 1)
    out = [math.sqrt(gamma ** degree / size) * (x @ r.choice([-1.0, 1.0], (degree, d)).T).prod(1) for _ in range(size)]
    return np.stack(out, 1)


def _rounded(u: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """max(0, u) with its corner rounded over [-h, h]: value and two derivatives."""
    inside = np.clip((u + h) / (2 * h), 0, 1)
    return np.where(u >= h, u, inside * inside * h), inside, ((u > -h) & (u < h)) / (2 * h)


def losses(f: np.ndarray, y: np.ndarray, epsilon: float | None, h: float):
    """Value and two derivatives by ``f`` of the hinge loss (``epsilon`` None, ``y`` -1 or 1)
    or of the epsilon-insensitive loss."""
    if epsilon is None:
        v, a, b = _rounded(1 - y * f, h)
        return v, -y * a, b
    v1, a1, b1 = _rounded(f - y - epsilon, h)
    v2, a2, b2 = _rounded(y - f - epsilon, h)
    return v1 + v2, a1 - a2, b1 + b2


class Machine:
    """One objective over the rows ``(x, y, fold)``: of the class ``side`` against the others (None:
    regression on ``y``), on the rows outside the fold ``without`` (None: all)."""

    def __init__(self, n: int, c: float, side: int | None = None, without: int | None = None, epsilon: float | None = None,
                 scale: float = 1.0):
        self.n, self.c, self.side, self.without, self.epsilon, self.scale = max(n, 1), c, side, without, epsilon, scale

    def part(self, x, y, fold, n):
        """Its rows, their targets and how often each counts."""
        if self.without is not None:
            mine = fold != self.without
            x, y, n = x[mine], y[mine], n[mine]
        return x, (y if self.side is None else np.where(y == self.side, 1.0, -1.0)), n

    def descend(self, dims: int):
        """Newton steps as a generator: asks for the sums at a point and a width, is sent value,
        gradient and second derivatives there, and returns the weights."""
        w = np.zeros(dims + 1)
        ridge = np.append(np.full(dims, 1.0 / (self.c * self.n)), 1e-12)

        def at(w, s):
            k, s = dims + 1, s / self.n
            return s[0] + ridge @ (w * w) / 2, s[1:1 + k] + ridge * w, s[1 + k:].reshape(k, k) + np.diag(ridge)

        for last in range(len(WIDTHS)):
            h, near = WIDTHS[last] * self.scale, 1e-5 if last == len(WIDTHS) - 1 else 1e-3
            value, g, curve = at(w, (yield w, h))
            for _ in range(STEPS):
                # where no row bends the loss, a little of its own scale keeps the step finite
                step = np.linalg.solve(curve + np.eye(dims + 1) * 1e-10 * max(1e-12, np.trace(curve)), -g)
                gain = -g @ step
                if gain <= near * (abs(value) + 1e-12):
                    break
                t, moved, small = 1.0, False, False
                for _ in range(HALVINGS):
                    new = at(w + t * step, (yield w + t * step, h))
                    if new[0] <= value - 1e-4 * t * gain:
                        w, moved, small = w + t * step, True, value - new[0] <= near * abs(value)
                        value, g, curve = new
                        break
                    t /= 4
                if not moved or small:
                    break
        return w


def _packed(batches):
    """Rows ``(x, y, fold, n)`` as blocks of doubles, which a pass reads as they lie."""
    for b in batches:
        if not b.num_rows:
            continue
        x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        table = np.column_stack([x, *(b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold", "n"))]).astype(float)
        step = max(1, BLOCK // (8 * table.shape[1]))
        yield pa.RecordBatch.from_arrays([pa.array([table[i:i + step].tobytes() for i in range(0, len(table), step)], pa.binary())], names=["block"])


def _sums(asked: list, inputs: int, mapped):
    """``asked (number, machine, w, h)``: a task's sums for each machine, in parts."""
    def run(batches):
        totals: dict = {}
        for block in (v for b in batches for v in b.column("block")):
            table = np.frombuffer(block.as_buffer()).reshape(-1, inputs + 3)
            x = mapped(table[:, :inputs])
            x = np.concatenate([x, np.ones((len(x), 1))], 1)
            y, fold, n = (table[:, inputs + i] for i in range(3))
            for number, machine, w, h in asked:
                mine, target, often = machine.part(x, y, fold, n)
                d = len(w)
                total = totals.setdefault(number, np.zeros(1 + d + d * d))
                v, g, c = (s * often for s in losses(mine @ w, target, machine.epsilon, h))
                bent = np.flatnonzero(c)
                total[0] += v.sum()
                total[1:1 + d] += g @ mine
                total[1 + d:] += ((mine[bent] * c[bent, None]).T @ mine[bent]).ravel()
        for number, total in totals.items():
            parts = [total[i:i + PART] for i in range(0, len(total), PART)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(parts), number), pa.int32()), pa.array(np.arange(len(parts)), pa.int32()),
                 pa.array([p.tobytes() for p in parts], pa.binary())], names=["machine", "part", "total"])
    return run


def _added(t: pa.Table) -> pa.Table:
    t = t.sort_by("total")      # one order, so that a rerun rounds alike
    total = sum(np.frombuffer(x.as_buffer()) for x in t.column("total"))
    return pa.table({"machine": t.column("machine")[:1], "part": t.column("part")[:1], "total": pa.array([total.tobytes()], pa.binary())})


def solve(rows: DataFrame, dims: int, machines: Sequence[Machine], inputs: int | None = None, mapped=None) -> list[np.ndarray]:
    """Weights and the intercept (last) of every machine for rows ``(x array<double>, y double,
    fold int)`` that count once, or ``n`` times.  All machines share the passes: one answers what
    each of them asks next.  ``mapped``: the ``dims`` points that a task makes of ``inputs`` values of
    a row in every pass, so that only the inputs are held."""
    if "n" not in rows.columns:
        rows = rows.withColumn("n", F.lit(1))
    inputs, mapped = inputs or dims, mapped or (lambda x: x)
    held = rows.select("x", "y", "fold", "n").mapInArrow(lambda batches: _packed(batches), "block binary").cache()
    schema = "machine int, part int, total binary"
    runs = [m.descend(dims) for m in machines]
    asks = {i: next(r) for i, r in enumerate(runs)}
    out: list = [None] * len(machines)
    while asks:
        asked = [(i, machines[i], w, h) for i, (w, h) in asks.items()]
        found: dict = {}
        for r in held.mapInArrow(_sums(asked, inputs, mapped), schema).groupBy("machine", "part") \
                .applyInArrow(lambda t: _added(t), schema).collect():
            found.setdefault(r["machine"], {})[r["part"]] = np.frombuffer(bytes(r["total"]))
        for i in list(asks):
            k = dims + 1
            try:
                asks[i] = runs[i].send(np.concatenate([found[i][p] for p in sorted(found[i])]) if i in found else np.zeros(1 + k + k * k))
            except StopIteration as end:
                out[i] = end.value
                del asks[i]
    held.unpersist()
    return out


def _fold(inputs: Sequence[str], label: str) -> Column:
    """A fold by the row's content: copies fall together."""
    return F.pmod(F.xxhash64(*inputs, label, F.lit(11)), F.lit(FOLDS))


def platt(margins: DataFrame) -> tuple[float, float]:
    """Slope and intercept of the sigmoid of ``margins (m double, positive boolean)`` that count once,
    or ``n`` times, with Platt's targets that leave room for error."""
    often = F.col("n") if "n" in margins.columns else F.lit(1)
    r = margins.agg(F.sum(F.when(F.col("positive"), often)).alias("p"), F.sum(F.when(~F.col("positive"), often)).alias("n")).first()
    positive, negative = r["p"] or 0, r["n"] or 0
    high, low = (positive + 1.0) / (positive + 2.0), 1.0 / (negative + 2.0)
    target = F.when(F.col("positive"), high).otherwise(low)
    rows = margins.select("m", F.inline(F.array(F.struct(F.lit(1.0).alias("y"), (often * target).alias("wt")),
                                                F.struct(F.lit(0.0).alias("y"), (often * (1 - target)).alias("wt")))))
    fit = Pipeline(stages=[VectorAssembler(inputCols=["m"], outputCol="f"),
                           LogisticRegression(featuresCol="f", labelCol="y", weightCol="wt", regParam=0.0, maxIter=100,
                                              tol=1e-9, standardization=False)]).fit(rows).stages[-1]
    return float(fit.coefficients[0]), float(fit.intercept)


def fit_svm(df: DataFrame, stages: list, inputs: Sequence[str], label: str, problem: str, params: dict | None = None,
            n_classes: int = 2, seed: int = 42, prediction: str = "prediction") -> PipelineModel:
    """A ``PipelineModel`` that adds ``prediction`` and, for classes, ``probability``
    (an array).  ``stages`` make the columns ``inputs`` of a row.  Parameters: ``C``, ``kernel``
    (rbf), ``gamma`` (scale), ``degree`` (3), ``epsilon`` (0.1), ``probability`` (true)."""
    p = {"C": 1.0, "kernel": "rbf", "gamma": "scale", "degree": 3, "epsilon": 0.1, "probability": True} | (params or {})
    ready = df
    for s in stages:
        ready = s.transform(ready)
    gamma = 1.0 if p["kernel"] == "linear" else resolve_gamma(ready, [F.col(c) for c in inputs], p["gamma"])
    terms = kernel_map(inputs, p["kernel"], gamma, p["degree"], seed)
    # inputs, not their map of up to MAP columns, are held; equal rows once, with their number
    mapped = lambda x: kernel_points(x, p["kernel"], gamma, p["degree"], seed)
    rows = ready.select(*inputs, F.col(label).cast("double").alias("y"), _fold(inputs, label).alias("fold")).where("y is not null") \
        .groupBy(*inputs, "y", "fold").agg(F.count(F.lit(1)).alias("n")).cache()
    held = rows.select(F.array(*inputs).alias("x"), "y", "fold", "n")
    points = rows.select(F.array(*[F.expr(t) for t in terms]).alias("x"), "y", "fold", "n")
    n, dims, c = rows.agg(F.sum("n")).first()[0] or 0, len(terms), float(p["C"])
    if not n:
        raise ValueError("no rows to fit")
    names = [f"_k_{j}" for j in range(dims)]
    made = SQLTransformer(statement="SELECT *, " + ", ".join(f"{t} AS `{k}`" for t, k in zip(terms, names)) + " FROM __THIS__")
    drop = ", ".join(f"`{k}`" for k in names)
    if not problem.lower().startswith("class"):
        mean = rows.agg(F.sum(F.col("y") * F.col("n"))).first()[0] / n
        spread = math.sqrt(rows.agg(F.sum((F.col("y") - mean) ** 2 * F.col("n"))).first()[0] / n) or 1.0
        w = solve(held, dims, [Machine(n, c, epsilon=float(p["epsilon"]), scale=spread)], len(inputs), mapped)[0]
        rows.unpersist()
        out = SQLTransformer(statement=f"SELECT * EXCEPT ({drop}), {_linear(w[:-1], names, w[-1])} AS `{prediction}` FROM __THIS__")
        return PipelineModel(stages=[*stages, made, out])
    # two classes have one machine, more one for each class against the others; and one without each fold
    targets = [1] if n_classes <= 2 else list(range(n_classes))
    folds = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.sum("n").alias("n")).collect()} if p["probability"] else {}
    machines = [Machine(n - folds.get(f, 0), c, k, f) for k in targets for f in (None, *sorted(folds))]
    weights = iter(solve(held, dims, machines, len(inputs), mapped))
    margins, odds = [], []
    for k in targets:
        w = next(weights)
        margins.append(_linear(w[:-1], names, w[-1]))
        if p["probability"]:
            seen = None
            for f in sorted(folds):
                wf = next(weights)
                dot = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in wf[:-1]]), lambda a, b: a * b),
                                  F.lit(float(wf[-1])), lambda s, v: s + v)
                seen = F.when(F.col("fold") == f, dot) if seen is None else seen.when(F.col("fold") == f, dot)
            odds.append(platt(points.select(seen.alias("m"), (F.col("y") == k).alias("positive"), "n")))
    rows.unpersist()
    found = SQLTransformer(statement="SELECT *, array(" + ", ".join(margins) + ") AS _margins FROM __THIS__")
    if len(targets) == 1:
        best = "CASE WHEN _margins[0] > 0 THEN 1.0D ELSE 0.0D END"
    else:
        best = "cast(array_position(_margins, array_max(_margins)) - 1 AS double)"
    columns = f"{best} AS `{prediction}`"
    if p["probability"]:
        each = [f"1 / (1 + exp(-(({a!r}D) * _margins[{i}] + ({b!r}D))))" for i, (a, b) in enumerate(odds)]
        if len(targets) == 1:
            shares = f"array(1 - {each[0]}, {each[0]})"
        else:
            shares = f"transform(array({', '.join(each)}), p -> p / ({' + '.join(each)}))"
        columns += f", {shares} AS probability"
    out = SQLTransformer(statement=f"SELECT * EXCEPT ({drop}, _margins), {columns} FROM __THIS__")
    return PipelineModel(stages=[*stages, made, found, out])
