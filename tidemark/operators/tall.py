"""Operators for groups that are far too tall for one task: least squares, order statistics, diameters.

Each keeps something small and mergeable for a group (outer-product sums, counts of ranges, a convex hull), worked out where the
rows are and added up by Spark. No group's rows come together in one task or on the driver, whatever its share of all rows.

Defined results: rows with a null or NaN in what is used are left out, and so are groups without any other; null keys are a key
like others. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import cut

#: Groups whose small table may be broadcast, and ranges that a bracket is divided into.
MOST_BROADCAST, RANGES = 100_000, 1024
#: Group sums or hulls that a task keeps before it hands them on.
KEPT = 1000


def _packed_key(keys: list[str]) -> Column:
    """All keys as one string that tells them apart, nulls too; the task sums by it."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("{}")


# ---- least squares ----


def gram(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, k, gram (k x k sums of products of the array x, row by row), xy (k sums with y), yy: by group.

    A task adds up the outer products of its rows by group; Spark adds up those sums position by position, so that even a group
    with all rows and a wide x is spread over tasks. All x of a group must have one length.
    """
    key = _packed_key(keys)
    some = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")) & F.forall(F.col(x), lambda v: v.isNotNull() & ~F.isnan(v.cast("double"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.ravel().tolist() for s in sums.values()], pa.list_(pa.float64()))], ["_key", "_sums"])

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            which, target = coded.indices.to_numpy(), batch.column(2).to_numpy()
            start, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            for g, name in enumerate(coded.dictionary.to_pylist()):
                at = np.flatnonzero(which == g)
                width = start[at[0] + 1] - start[at[0]]
                if (start[at + 1] - start[at] != width).any():
                    raise ValueError(f"rows of different length in group {name}")
                z = np.concatenate((values[start[at][:, None] + np.arange(width)], target[at, None], np.ones((len(at), 1))), 1)
                own = z.T @ z
                sums[name] = sums[name] + own if name in sums else own
            if len(sums) >= KEPT:
                yield out()
                sums.clear()
        if sums:
            yield out()

    partial = some.select(key.alias("_key"), F.col(x).cast("array<double>").alias("_x"), F.col(y).cast("double").alias("_y")).mapInArrow(run, "_key string, _sums array<double>")
    added = partial.select("_key", F.posexplode("_sums").alias("_at", "_v")).groupBy("_key", "_at").agg(F.sum("_v").alias("_v"))
    whole = added.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda s: s["_v"]).alias("_s"))
    side = F.sqrt(F.size("_s")).cast("int")
    k = side - 2
    part = lambda r, c, n: F.slice("_s", r * side + c + 1, n)
    square = F.flatten(F.transform(F.sequence(F.lit(0), k - 1), lambda r: part(r, F.lit(0), k)))
    schema = rows.select(*keys).schema.simpleString() if keys else None
    named = whole.select(*([F.from_json("_key", schema).alias("_k")] if keys else []), F.element_at("_s", -1).cast("bigint").alias("n"), k.alias("k"), square.alias("gram"), part(k, F.lit(0), k).alias("xy"), F.element_at(part(k, k, 1), 1).alias("yy"))
    return named.select(*(F.col(f"_k.{c}").alias(c) for c in keys), "n", "k", "gram", "xy", "yy")


def ridge(rows: DataFrame, keys: list[str], x: str, y: str, alpha: float = 0.0) -> DataFrame:
    """keys, n, coef (k), sse: the ridge solution of every group, (X'X + alpha I) coef = X'y, from its sums alone.

    A constant among x is a coefficient like others and regularised too. Without alpha a singular group has its least-norm solution.
    """
    sums = gram(rows, keys, x, y)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            coef, sse = [], []
            for k, g, xy, yy in zip(batch["k"], batch["gram"], batch["xy"], batch["yy"], strict=True):
                g, xy = np.asarray(g, float).reshape(k, k), np.asarray(xy, float)
                b = np.linalg.solve(g + alpha * np.eye(k), xy) if alpha else np.linalg.lstsq(g, xy, rcond=None)[0]
                coef.append(b)
                sse.append(max(0.0, yy - 2 * b @ xy + b @ g @ b))
            yield batch[[*keys, "n"]].assign(coef=coef, sse=sse)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*keys).schema), "n bigint, coef array<double>, sse double"])
    return sums.mapInPandas(run, schema)


# ---- order statistics ----


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """keys, n and a column for each name in ``ranks``: the exact value of that rank (from 1; a column over n) in its group, null
    where the group is too small.

    The bracket that holds a rank starts as the group's range and narrows: each pass counts the values in RANGES parts of every
    bracket (partial sums), and the part with the rank is the next one, from its least to its greatest value. Parts lose at
    least one distinct value a pass; usually three or four passes end it.
    """
    keyed = df.select(*(F.col(c) for c in keys), F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)")
    base = cut(keyed.withColumn("_g", _packed_key(keys)))
    sizes = cut(base.groupBy("_g", *keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items())))
    state = cut(sizes.select("_g", "n", wanted.alias("_w"), "_low", "_high").select("_g", F.col("_w.name").alias("_name"), F.col("_w.rank").alias("_rank"), F.lit(0).cast("bigint").alias("_below"), "_low", "_high").filter("_rank BETWEEN 1 AND n"))
    values = base.select("_g", "_v")
    while count := state.filter("_low < _high").count():
        unsettled = state.filter("_low < _high")
        inside = values.join(F.broadcast(unsettled) if count <= MOST_BROADCAST else unsettled, "_g").filter("_v BETWEEN _low AND _high")
        share = F.expr("IF(isnan(_high - _low) OR _high - _low = double('inf'), (_v / 2 - _low / 2) / (_high / 2 - _low / 2), (_v - _low) / (_high - _low))")
        part = F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).alias("_part")
        counts = inside.groupBy("_g", "_name", "_rank", "_below", part).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        # A bracket's counts are at most RANGES rows.
        ordered = F.array_sort(F.collect_list(F.struct("_part", "_c", "_low", "_high")))
        packed = counts.groupBy("_g", "_name", "_rank", "_below").agg(ordered.alias("_parts"))
        step = F.expr("""aggregate(_parts, named_struct('below', _below, 'low', double(NULL), 'high', double(NULL)), (s, p) -> CASE
            WHEN s.low IS NOT NULL THEN s
            WHEN s.below + p._c >= _rank THEN named_struct('below', s.below, 'low', p._low, 'high', p._high)
            ELSE named_struct('below', s.below + p._c, 'low', s.low, 'high', s.high) END)""")
        next_ = packed.select("_g", "_name", "_rank", step.alias("_s")).select("_g", "_name", "_rank", F.col("_s.below").alias("_below"), F.col("_s.low").alias("_low"), F.col("_s.high").alias("_high"))
        state = cut(state.filter("_low >= _high").unionByName(next_))
    found = state.groupBy("_g").pivot("_name", list(ranks)).agg(F.first("_low"))
    return sizes.join(found, "_g", "left").select(*keys, "n", *ranks)


def median_ranks(n: Column) -> dict[str, Column]:
    """The one or two middle ranks."""
    return {"lower_median": F.floor((n + 1) / 2), "upper_median": F.floor(n / 2) + 1}


# ---- diameters ----


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points in the plane, in order, without points on its edges; all points if there are at most two."""
    p = np.unique(points, axis=0)
    # Extreme points in a few directions rule out what lies inside of their polygon.
    if len(p) > 200:
        a = np.arange(16) * np.pi / 8
        far = p[np.unique((p @ np.stack((np.cos(a), np.sin(a)))).argmax(0))]
        if len(far) > 2:
            corners = hull(far)
            ahead = np.roll(corners, -1, 0)
            inside = np.ones(len(p), bool)
            for (x0, y0), (x1, y1) in zip(corners, ahead, strict=True):
                size = abs((x1 - x0) * (np.abs(p[:, 1]) + abs(y0))) + abs((y1 - y0) * (np.abs(p[:, 0]) + abs(x0)))
                inside &= (x1 - x0) * (p[:, 1] - y0) - (y1 - y0) * (p[:, 0] - x0) > 1e-12 * size
            p = p[~inside]
    if len(p) <= 2:
        return p
    out: list = []
    for side in (p, p[::-1]):
        line: list = []
        for q in side.tolist():
            while len(line) > 1 and (line[-1][0] - line[-2][0]) * (q[1] - line[-2][1]) - (line[-1][1] - line[-2][1]) * (q[0] - line[-2][0]) <= 0:
                line.pop()
            line.append(q)
        out += line[:-1]
    return np.array(out)


def widest(corners: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Greatest distance of two of the points, and the two; in blocks, so that memory is linear."""
    best = (0.0, corners[0], corners[0])
    for at in range(0, len(corners), 256):
        d = ((corners[at : at + 256, None, :] - corners[None]) ** 2).sum(2)
        i, j = np.unravel_index(d.argmax(), d.shape)
        if d[i, j] > best[0] ** 2:
            best = (float(np.sqrt(d[i, j])), corners[at + i], corners[j])
    return best


def diameter(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, diameter: the greatest distance between two points of a group in the plane (0 for one point).

    Both ends are corners of the convex hull. Tasks reduce their rows to the corners by group; corners meet by group and one of
    64 parts, then by group. Points all on a circle are all corners: a group's corners, not its rows, must fit a task.
    """

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            for g, rows in batch.groupby("_g"):
                new = rows[["_x", "_y"]].to_numpy()
                kept[g] = hull(np.concatenate((kept[g], new)) if g in kept else new)
            if len(kept) >= KEPT:
                yield pd.concat([pd.DataFrame({"_g": g, "_x": p[:, 0], "_y": p[:, 1]}) for g, p in kept.items()])
                kept.clear()
        if kept:
            yield pd.concat([pd.DataFrame({"_g": g, "_x": p[:, 0], "_y": p[:, 1]}) for g, p in kept.items()])

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        p = hull(rows[["_x", "_y"]].to_numpy())
        return pd.DataFrame({"_g": rows["_g"].iloc[0], "_x": p[:, 0], "_y": p[:, 1]})

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_g": [rows["_g"].iloc[0]], "diameter": [widest(hull(rows[["_x", "_y"]].to_numpy()))[0]]})

    plane = points.select(_packed_key(keys).alias("_g"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter("_x IS NOT NULL AND _y IS NOT NULL AND NOT isnan(_x) AND NOT isnan(_y)")
    first = plane.mapInPandas(corners, "_g string, _x double, _y double")
    second = first.withColumn("_part", F.pmod(F.hash("_x", "_y"), F.lit(64))).groupBy("_g", "_part").applyInPandas(merged, "_g string, _x double, _y double")
    out = second.groupBy("_g").applyInPandas(across, "_g string, diameter double")
    if not keys:
        return out.select("diameter")
    return out.select(F.from_json("_g", points.select(*keys).schema.simpleString()).alias("_k"), "diameter").select(*(F.col(f"_k.{c}").alias(c) for c in keys), "diameter")
