"""Embedding whitening from upper-triangle column aggregates.

Entries become whole numbers, floor(scale * c) + shift. The distinct vectors are
the fit list, written once. One aggregation gives their number and the sum of
every dimension; the next one sums, as generated Spark SQL, the centred product
of every pair of dimensions: an expression a column of the upper triangle, in
groups by its row. The driver puts the
covariance together (a number for each pair, whatever the number of rows) and
decomposes it with LAPACK. A last pair of aggregations over the whitened fit
list measures how far its covariance is from the identity.

Rows with a null vector, or with null or non-finite entries, take no part. Rows
with a null id stay, with a null id; repeated ids and repeated vectors are rows
each, but a vector counts once in the fit. Vectors of each length are whitened
among themselves, those without entries give no rows. Directions in which the
fit list doesn't vary can't be whitened and are left out, so a fit list of one
vector gives none. Beyond 64 bits an entry is an error and a deviation is null. Very
long vectors take several aggregations, each of at most ``MOST_SUMS`` columns.
Columns beside id and vector, whatever their names, are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.llm.common import SharedTables

#: Sums (columns of the triangle) in one aggregation, at most.
MOST_SUMS = 256
#: A variance counts as none below this part of the largest one.
NO_VARIANCE = 1e-12
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vectors: DataFrame, scale: int, shift: int) -> DataFrame:
    """vec_id and x, the vector in whole numbers, of every row that takes part."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(
        F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    )
    return usable.select("vec_id", F.transform("v", lambda c: F.floor(c * scale) + F.lit(shift).cast("long")).alias("x"))


def pair_sums(rows: DataFrame, column: str, centre: list[float]) -> np.ndarray:
    """Sums over all rows of (x_i - centre_i) * (x_j - centre_j), as a symmetric matrix.

    A generated expression is a column j of the upper triangle, and a group is
    its row i, so all pairs are sums of one aggregation with a small plan.
    """
    dim = len(centre)
    out = np.zeros((dim, dim))
    for at in range(0, dim, MOST_SUMS):
        end = min(dim, at + MOST_SUMS)
        # every centred column is made once, the products are of columns
        centred = rows.selectExpr(*[f"{column}[{i}] - double('{float(centre[i])!r}') AS c{i}" for i in range(end)])
        each = centred.selectExpr("*", f"posexplode(array({', '.join(f'c{i}' for i in range(end))})) AS (i, ci)")
        for row in each.groupBy("i").agg(*[F.expr(f"sum(if(i <= {j}, ci * c{j}, 0d))") for j in range(at, end)]).collect():
            out[row.i, at:end] = row[1:]
    return np.triu(out) + np.triu(out, 1).T


def _columns(rows: DataFrame, dim: int, make) -> list[tuple]:
    """make(i) gives the aggregates of column i; their values by column, with a few hundred columns an aggregation."""
    found = []
    for at in range(0, dim, 512):
        some = range(at, min(dim, at + 512))
        made = [make(i) for i in some]
        row = tuple(rows.agg(*[x for m in made for x in m]).first())
        size = len(made[0])
        found += [row[k * size : (k + 1) * size] for k in range(len(made))]
    return found


def _one_length(rows: DataFrame, fit: DataFrame, dim: int, components: int) -> DataFrame | None:
    x = lambda i: F.col("x")[i]
    n = fit.count()
    stats = _columns(fit, dim, lambda i: (F.sum(x(i)), F.min(x(i)), F.max(x(i))))
    sums = [int(s) for s, _, _ in stats]
    mean = np.array([s / n for s in sums])
    covariance = pair_sums(fit, "x", mean.tolist()) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = [k for k in range(min(components, dim)) if values[k] > max(values[0], 0) * NO_VARIANCE]
    if not kept:
        return None
    project = vectors[:, kept] / np.sqrt(values[kept])
    trace = float(np.trace(covariance))

    def whitened(batches):
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy().reshape(-1, dim)
            w = np.ascontiguousarray((flat - mean) @ project)
            made = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), len(kept)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([made, *batch.columns[1:]], names=["w", *batch.schema.names[1:]])

    check = fit.select("x").mapInArrow(whitened, "w array<double>")
    centre = [s / n for (s,) in _columns(check, len(kept), lambda i: (F.sum(F.col("w")[i]),))]
    error = float(np.abs(pair_sums(check, "w", centre) / n - np.eye(len(kept))).max())

    # n * x - S in whole numbers; the largest possible sum tells whether 64 bits are enough
    furthest = [max(abs(n * lo - s), abs(n * hi - s)) for s, lo, hi in stats]
    total = "array(" + ",".join(f"{s}L" if abs(s) < 2**63 else f"cast('{s}' as decimal(38,0))" for s in sums) + ")"
    if sum(f * f for f in furthest) < 2**63 and all(n * max(abs(lo), abs(hi)) < 2**63 for _, lo, hi in stats):
        deviation = F.expr(f"aggregate(zip_with(x, {total}, (a, s) -> ({n}L * a - s) * ({n}L * a - s)), 0L, (t, d) -> t + d)")
    else:
        off = f"(cast({n} as decimal(19,0)) * cast(a as decimal(19,0)) - cast(s as decimal(38,0)))"
        wide = f"aggregate(zip_with(x, {total}, (a, s) -> try_multiply(cast({off} as decimal(38,0)), cast({off} as decimal(38,0)))), cast(0 as decimal(38,0)), (t, d) -> cast(try_add(t, d) as decimal(38,0)))"
        deviation = F.expr(f"try_cast({wide} as bigint)")
    done = rows.select("x", "vec_id", deviation.alias("deviation")).mapInArrow(whitened, "w array<double>, vec_id long, deviation long")
    explained = F.array(*[F.lit(float(values[k] / trace)) for k in kept])
    return done.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def whiten(vectors: DataFrame, scale: int = 64, shift: int = 1_000_000, components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row a vector and component."""
    spark = vectors.sparkSession
    store = SharedTables(spark, "whitening")
    rows = whole_numbers(vectors, scale, shift)
    fit = store.write(rows.select("x").distinct(), "fit")
    made = []
    for dim in sorted(r[0] for r in fit.select(F.size("x")).distinct().collect()):  # one row a length
        if dim:
            same = F.size("x") == dim
            made.append(_one_length(rows.filter(same), fit.filter(same), dim, components))
    made = [m for m in made if m is not None]
    return reduce(DataFrame.unionByName, made) if made else spark.createDataFrame([], RESULT)
