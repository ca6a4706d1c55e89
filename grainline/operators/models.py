"""Linear models whose columns are many, from sufficient statistics (family K)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns (levels of all blocks but the largest, and numbers) of a system that the driver solves: one of 2,000 takes it about a second and 64 MB.
MOST_COLUMNS = 2000
INTERCEPT = "1"


@dataclass
class Effects:
    """A ridge with an effect for each level of each block: coef (of numbers, and of the levels of the small blocks) by name on the driver,
    the largest block's effects in a table (level, effect)."""

    numeric: dict[str, tuple[float, float, float]]
    blocks: dict[str, Column]
    big: Column
    coef: dict[str, float]
    table: DataFrame

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows plus prediction. A level that the fit has not seen, or NULL, has effect 0."""
        out, total = rows, F.lit(self.coef.get(INTERCEPT, 0.0))
        for name, (middle, mean, sd) in self.numeric.items():
            total = total + (F.coalesce(F.col(name).cast("double"), F.lit(middle)) - mean) / sd * self.coef.get(f"{name}:", 0.0)
        for i, (block, level) in enumerate(self.blocks.items()):
            own = [(k.split("=", 1)[1], v) for k, v in self.coef.items() if k.startswith(f"{block}=")]
            table = rows.sparkSession.createDataFrame(own, f"_l{i} string, _e{i} double")
            out = out.join(F.broadcast(table), level.cast("string") == F.col(f"_l{i}"), "left")
            total = total + F.coalesce(f"_e{i}", F.lit(0.0))
        out = out.join(self.table.select(F.col("level").alias("_level"), F.col("effect").alias("_effect")), self.big.cast("string") == F.col("_level"), "left")
        return out.withColumn("prediction", total + F.coalesce("_effect", F.lit(0.0))).select(*rows.columns, "prediction")


def ridge_effects(rows: DataFrame, numeric: list[str], blocks: dict[str, Column], big: Column, y: str, weight: str, alpha: float, sweeps: int | None = None) -> Effects:
    """The weighted ridge of y on standardised numbers and one 0/1 column a level of each block, with a free intercept, solved by block
    elimination. Only products that occur are summed, as rows (column, column, sum). The largest block, `big`, has a diagonal Gram block, so
    its levels are eliminated where they are: each takes g g' / (weight + alpha) off the rest's system, g its own sums by column, and gets its effect from
    the rest's solution. Any number of its levels stays in a table; the driver solves the rest, at most MOST_COLUMNS columns (an error above).
    NULL numbers take the median; rows without y are left out; a NULL level has no column. sweeps: that many sweeps of updates instead of the exact solution,
    of the intercept, the numbers and the blocks in turn and `big` last, each exact with the others held, from effects of 0."""
    own = rows.where(F.col(y).isNotNull() & (F.col(weight) > 0))
    w = F.col(weight).cast("double")
    middle = [F.when(F.count_if(F.col(c).isNull()) > 0, F.percentile_approx(F.col(c).cast("double"), 0.5, 10_000)) for c in numeric]
    first = own.agg((F.sum(w * F.col(y)) / F.sum(w)).alias("y"), *(m.alias(f"m{i}") for i, m in enumerate(middle))).first()
    fill = {c: float(first[f"m{i}"] or 0.0) for i, c in enumerate(numeric)}
    whole = {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fill.items()}
    means = own.agg(F.sum(w).alias("w"), *((F.sum(w * x) / F.sum(w)).alias(f"a{i}") for i, x in enumerate(whole.values()))).first()
    mean = {c: float(means[f"a{i}"] or 0.0) for i, c in enumerate(numeric)}
    spread = own.agg(F.lit(1), *((F.sum(w * (x - mean[c]) * (x - mean[c])) / F.sum(w)).alias(f"v{i}") for i, (c, x) in enumerate(whole.items()))).first()
    scale = {c: (fill[c], mean[c], float(np.sqrt(spread[f"v{i}"]))) for i, c in enumerate(numeric) if (spread[f"v{i}"] or 0) > 1e-30 * mean[c] ** 2}
    centre = float(first["y"] or 0.0)
    term = lambda name, value: F.struct(name.alias("name"), value.alias("v"))
    terms = [term(F.lit(INTERCEPT), F.lit(1.0)), *(term(F.lit(f"{c}:"), (whole[c] - m) / s) for c, (_, m, s) in scale.items()), *(term(F.concat(F.lit(f"{b}="), c.cast("string")), F.lit(1.0)) for b, c in blocks.items())]
    data = own.select(big.cast("string").alias("level"), w.alias("w"), (w * (F.col(y) - centre)).alias("wy"), F.filter(F.array(*terms), lambda x: x["name"].isNotNull()).alias("terms"))

    pairs = "flatten(transform({0}, a -> transform(filter({0}, b -> a.name <= b.name), b -> struct(a.name AS a, b.name AS b, {1} AS q))))"
    products = data.select(F.explode(F.expr(pairs.format("terms", "w * a.v * b.v"))).alias("p")).select("p.*")
    each = data.select("level", "w", "wy", F.explode("terms").alias("t")).select("level", "t.name", (F.col("w") * F.col("t.v")).alias("g"), (F.col("wy") * F.col("t.v")).alias("y"))
    levels = data.where("level IS NOT NULL").groupBy("level").agg(F.sum("w").alias("w"), F.sum("wy").alias("h"))
    held = each.where("level IS NOT NULL").groupBy("level", "name").agg(F.sum("g").alias("g")).groupBy("level").agg(F.collect_list(F.struct("name", "g")).alias("terms")).join(levels, "level")
    taken = held.select(F.explode(F.expr(pairs.format("terms", f"-a.g * b.g / (w + {alpha!r}D)"))).alias("p")).select("p.*")
    right = each.select("name", "y").unionByName(held.select(F.explode("terms").alias("t"), "h", "w").select(F.col("t.name").alias("name"), (-F.col("t.g") * F.col("h") / (F.col("w") + alpha)).alias("y")))
    b = {r["name"]: r["y"] for r in right.groupBy("name").agg(F.sum("y").alias("y")).limit(MOST_COLUMNS + 1).collect()}
    if len(b) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns beside the largest block")
    at = {name: i for i, name in enumerate(sorted(b))}
    a, off = np.diag([0.0 if name == INTERCEPT else float(alpha) for name in at]), np.zeros((len(at), len(at)))
    # what the rows add and what the largest block takes off; at most MOST_COLUMNS squared
    for r in products.groupBy("a", "b").agg(F.sum("q").alias("q"), F.lit(0.0).alias("o")).unionByName(taken.groupBy("a", "b").agg(F.lit(0.0).alias("q"), F.sum("q").alias("o"))).groupBy("a", "b").agg(F.sum("q").alias("q"), F.sum("o").alias("o")).toLocalIterator():
        i, j = at[r["a"]], at[r["b"]]
        for m, v in ((a, r["q"]), (off, r["o"])):
            m[i, j] += v
            m[j, i] += v if i != j else 0
    if sweeps is None:
        solved = np.linalg.solve(a + off, [b[name] for name in at]) if at else []
    else:
        plain = {r["name"]: r["y"] for r in each.groupBy("name").agg(F.sum("y").alias("y")).collect()}
        parts = [[at[INTERCEPT]], *([at[f"{c}:"]] for c in scale), *([i for n, i in at.items() if n.startswith(f"{k}=")] for k in blocks)]
        solved = swept(a, off, np.array([plain[n] for n in at]), np.array([b[n] for n in at]), parts, sweeps)
    coef = {name: float(v) for name, v in zip(at, solved)}
    table = rows.sparkSession.createDataFrame(list(coef.items()), "name string, b double")
    rest = held.select("level", "w", "h", F.explode("terms").alias("t")).join(F.broadcast(table), F.col("t.name") == F.col("name")).groupBy("level", "w", "h").agg(F.sum(F.col("t.g") * F.col("b")).alias("x"))
    coef[INTERCEPT] = coef.get(INTERCEPT, 0.0) + centre
    return Effects(scale, blocks, big, coef, rest.select("level", ((F.col("h") - F.col("x")) / (F.col("w") + alpha)).alias("effect")))


def swept(a: np.ndarray, off: np.ndarray, plain: np.ndarray, b: np.ndarray, parts: list[list[int]], sweeps: int) -> np.ndarray:
    """The coefficients after a number of sweeps over parts whose own Gram blocks are diagonal. The largest block's effects follow from the
    coefficients of the sweep before: they take plain - b + off x from what the others see, nothing in the first sweep."""
    x, big = np.zeros(len(plain)), np.zeros(len(plain))
    for _ in range(sweeps):
        for part in parts:
            x[part] += (plain - big - a @ x)[part] / a[part, part]
        big = plain - b + off @ x
    return x


def logistic(df: DataFrame, features: list[str], hits: str, n: str, iterations: int = 8) -> np.ndarray:
    """Coefficients (the intercept first) of a logistic regression of hits among n per row, by Newton steps: each step is one aggregate of
    p x p sums and a solve on the driver."""
    cols = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    b = np.zeros(len(cols))
    for _ in range(iterations):
        z = sum((float(k) * c for k, c in zip(b[1:], cols[1:])), F.lit(float(b[0])))
        q = 1 / (1 + F.exp(-z))
        grad = [F.sum((F.col(hits) - F.col(n) * q) * c) for c in cols]
        hess = [F.sum(F.col(n) * q * (1 - q) * cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
        r = df.agg(F.array(*grad).alias("g"), F.array(*hess).alias("h")).first()
        if r["g"][0] is None:
            return b
        h = np.zeros((len(cols), len(cols)))
        h[np.triu_indices(len(cols))] = r["h"]
        b = b + np.linalg.solve(h + np.triu(h, 1).T, np.array(r["g"], float))
    return b
