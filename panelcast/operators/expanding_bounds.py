"""Walk-forward least squares whose clip bounds are fitted anew at every step, for all steps at once.

Steps are cut into blocks. Values of a column are cut into cells, and history meets a block as counts and product sums
per cell. From the counts follow the few cells in which a bound can lie while the block lasts; rows of those cells are
shipped one by one, all other rows as product sums per pattern of (below, between, above). A pattern's clipped products
are a linear map of its plain ones, whatever the bounds are, so each step costs the patterns and a few rows, not its
history.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.columns import finite
from panelcast.operators.regression import _solve, _unpack
from panelcast.sources.shared import written

BOUND_BLOCK = 4_096
CHUNK = 256
LOW, MIDDLE, HIGH, OPEN = range(4)
_FAR = 1 << 30


def _cell(value: Column, cuts: Column, side: int) -> Column:
    """How many of the side * side - 1 sorted cuts lie below ``value``, in two rounds of ``side`` comparisons."""
    coarse = F.transform(F.sequence(F.lit(1), F.lit(side - 1)), lambda i: F.get(cuts, i * side - 1))
    first = F.size(F.filter(coarse, lambda c: c < value)) * side
    fine = F.size(F.filter(F.slice(cuts, first + 1, side - 1), lambda c: c < value))
    return F.when(value.isNotNull() & cuts.isNotNull(), first + fine)


def _state(cell: str, j: int) -> Column:
    """Where a cell lies against all bounds that column ``j`` can have in the block."""
    c, e = F.col(cell), {k: F.col(f"_{k}{j}") for k in ("lo_from", "lo_to", "hi_from", "hi_to")}
    unsure = c.between(e["lo_from"], e["lo_to"]) | c.between(e["hi_from"], e["hi_to"])
    return F.when(c.isNull(), MIDDLE).when(unsure, OPEN).when(c < e["lo_from"], LOW).when(c > e["hi_to"], HIGH).otherwise(MIDDLE)


def _edges(grid: DataFrame, blocks: DataFrame, p: int, limits: tuple[float, float], rows: int) -> DataFrame:
    """Per (symbol, block) and column: the cells that can hold either bound, and the values below, above and in all.

    While up to ``rows`` values come in, the value of a rank keeps within ``rows`` ranks below it in the history.
    """
    named = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"_c{j}").alias("cell")) for j in range(p)]))
    counts = grid.select("symbol", "_known", "_n", named.alias("_e")).where("_e.cell is not null")
    counts = counts.groupBy("symbol", "_known", F.col("_e.j").alias("j"), F.col("_e.cell").alias("cell")).agg(F.sum("_n").alias("n"))
    seen = counts.join(blocks, "symbol").where("_known <= _block").groupBy("symbol", "_block", "j", "cell").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("symbol", "_block", "j")
    seen = seen.withColumns({"to": F.sum("n").over(own.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(own)})
    seen = seen.withColumn("from", F.col("to") - F.col("n"))
    keys = ["symbol", "_block", "j", "all"]
    found = []
    for name, q in zip(("lo", "hi"), limits, strict=True):
        least = F.floor(F.lit(q) * (F.col("all") - 1)) - rows
        most = F.ceil(F.lit(q) * (F.col("all") + rows - 1))
        found += [
            F.coalesce(F.max(F.when(F.col("from") <= least, F.col("cell"))), F.lit(-1)).alias(f"{name}_from"),
            F.coalesce(F.min(F.when(F.col("to") > most, F.col("cell"))), F.lit(_FAR)).alias(f"{name}_to"),
            F.coalesce(F.max(F.when(F.col("from") <= least, F.col("from"))), F.lit(0)).alias(f"{name}_below"),
            F.coalesce(F.col("all") - F.min(F.when(F.col("to") > most, F.col("to"))), F.lit(0)).alias(f"{name}_above"),
        ]
    per_column = seen.groupBy(*keys).agg(*found)
    empty = {"lo_from": -1, "lo_to": _FAR, "hi_from": -1, "hi_to": _FAR, "lo_below": 0, "hi_above": 0, "all": 0}
    wide = per_column.groupBy("symbol", "_block").agg(*[F.max(F.when(F.col("j") == j, F.col(k))).alias(f"_{k}{j}") for j in range(p) for k in empty])
    return blocks.join(wide, ["symbol", "_block"], "left").fillna({f"_{k}{j}": v for j in range(p) for k, v in empty.items()})


def step_bounds(steps: np.ndarray, known: np.ndarray, values: np.ndarray, shipped: np.ndarray, state: np.ndarray, counts: Sequence[int], limits: tuple[float, float]) -> np.ndarray:
    """(steps, 2): interpolated quantiles of one column at every step.

    ``shipped`` are earlier values with their ``state``, ``values`` come in at the steps ``known``; ``counts`` are the
    earlier values below, above and in all that stay outside the lists.
    """
    below, above, total = (int(c) for c in counts)
    fits = ~np.isnan(shipped)
    lists = [sorted(shipped[fits & (state != s)].tolist()) for s in (LOW, HIGH)]
    order = np.argsort(known, kind="stable")
    order = order[~np.isnan(values[order])]
    out, at = np.full((len(steps), 2), np.nan), 0
    for s, step in enumerate(steps.tolist()):
        while at < len(order) and known[order[at]] <= step:
            for held in lists:
                insort(held, float(values[order[at]]))
            total += 1
            at += 1
        if not total:
            continue
        for side, (held, q) in enumerate(zip(lists, limits, strict=True)):
            shift = -below if side == 0 else len(held) + above - total
            place = q * (total - 1)
            r = int(place)
            value = held[r + shift]
            if place > r:
                value += (held[r + 1 + shift] - value) * (place - r)
            out[s, side] = value
    return out


def clipped_sums(steps: np.ndarray, bounds: np.ndarray, patterns: dict[tuple, np.ndarray], x: np.ndarray, y: np.ndarray, known: np.ndarray) -> np.ndarray:
    """(steps, p + 2, p + 2): product sums of (1, clipped x, y) at every step.

    ``patterns`` hold the plain product sums of rows by their state in each column; the other rows are clipped one by
    one, or join a pattern for as long as no bound passes their values.
    """
    p = x.shape[1]
    full = np.zeros((len(steps), p + 2, p + 2))
    z = np.column_stack([np.ones(len(x)), x, y])
    whole = ~np.isnan(z).any(axis=1)
    z, x, known = z[whole], x[whole], known[whole]
    for at in range(0, len(steps), CHUNK):
        own, lo, hi = steps[at : at + CHUNK], bounds[at : at + CHUNK, :, 0], bounds[at : at + CHUNK, :, 1]
        state = np.full(x.shape, OPEN)
        state[x <= lo.min(axis=0)] = LOW
        state[(x >= lo.max(axis=0)) & (x <= hi.min(axis=0))] = MIDDLE
        state[x >= hi.max(axis=0)] = HIGH
        settled = (known <= own[0]) & (state != OPEN).all(axis=1)
        sums = {k: v.copy() for k, v in patterns.items()}
        codes, which = np.unique(state[settled], axis=0, return_inverse=True)
        for i, code in enumerate(codes):
            rows = z[settled][which == i]
            key = tuple(code.tolist())
            sums[key] = sums.get(key, 0.0) + rows.T @ rows
        for key, total in sums.items():
            turn = np.zeros((len(own), p + 2, p + 2))
            turn[:, 0, 0] = turn[:, -1, -1] = 1.0
            for j, s in enumerate(key, start=1):
                if s == MIDDLE:
                    turn[:, j, j] = 1.0
                else:
                    turn[:, j, 0] = (lo if s == LOW else hi)[:, j - 1]
            full[at : at + CHUNK] += turn @ total @ turn.transpose(0, 2, 1)
        loose = np.flatnonzero(~settled & (known <= own[-1]))
        for part in np.array_split(loose, max(1, len(loose) // 2048)):
            c = np.repeat(z[None, part], len(own), axis=0)
            c[:, :, 1:-1] = np.clip(c[:, :, 1:-1], lo[:, None], hi[:, None])
            c *= (known[part][None] <= own[:, None])[:, :, None]
            full[at : at + CHUNK] += c.transpose(0, 2, 1) @ c
    return full


def _forecasts(full: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Intercept and slopes of every step, applied to its own row."""
    n = full[:, 0, 0]
    n = np.where(n > 0, n, np.nan)
    mean = full[:, 0, 1:] / n[:, None]
    centred = full[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    out = mean[:, -1].copy()
    good = np.isfinite(centred).all(axis=(1, 2)) & np.isfinite(x).all(axis=1)
    out[~good] = np.nan
    slope = _solve(centred[good, :-1, :-1], centred[good, :-1, -1])
    out[good] += np.einsum("sj,sj->s", slope, x[good] - mean[good, :-1])
    return out


def walk_forward_refit_bounds(
    samples: DataFrame,
    columns: Sequence[str],
    horizon: int = 1,
    *,
    limits: tuple[float, float] = (0.01, 0.99),
    leak_safe: bool = True,
    target: str = "target",
    rows: int | None = None,
    side: int | None = None,
) -> DataFrame:
    """Test rows with ``predicted``: at each step, bounds and fit come from all rows whose target is known by then.

    ``rows`` is the length of a block of steps and ``side`` the square root of the number of cells of a column; neither
    changes the result. A row with a missing value counts for the bounds of its other columns only. A forecast is null
    where the row has a missing value or nothing is known yet.
    """
    rows, p = rows or BOUND_BLOCK, len(columns)
    delay = horizon if leak_safe else 1
    keep = samples.select("symbol", "split", "step", "feature_date", "target_date", "current_close", *dict.fromkeys([*columns, target]))
    history = keep.where("split <> 'test'")
    if side is None:
        largest = keep.groupBy("symbol").count().agg(F.max("count")).first()[0] or 0
        side = int(min(64, max(4, (largest / rows) ** 0.5)))
    # columns and target are taken from means of the history, so that product sums keep their digits
    centres = written(history.groupBy("symbol").agg(*[F.avg(finite(c)).alias(f"_m{k}") for k, c in enumerate([*columns, target])]), "centres")
    moved = keep.join(centres, "symbol", "left").select(
        "symbol", "split", "step",
        *[(finite(c) - F.coalesce(f"_m{k}", F.lit(0.0))).alias(f"_x{k}") for k, c in enumerate(columns)],
        (finite(target) - F.coalesce(f"_m{p}", F.lit(0.0))).alias("_y"), F.coalesce(f"_m{p}", F.lit(0.0)).alias("_level"),
    )
    cuts = [(i + 1) / side**2 for i in range(side**2 - 1)]
    placed = written(moved.groupBy("symbol").agg(*[F.percentile_approx(f"_x{j}", cuts, 20 * side**2).alias(f"_q{j}") for j in range(p)]), "cells")
    known_at = F.when(F.col("split") == "test", F.col("step") + delay).otherwise(F.lit(1))
    ready = moved.join(placed, "symbol").select(
        "symbol", "split", "step", *[f"_x{j}" for j in range(p)], "_y", "_level", known_at.alias("_at"),
        F.floor((known_at + rows - 2) / rows).alias("_known"), *[_cell(F.col(f"_x{j}"), F.col(f"_q{j}"), side).alias(f"_c{j}") for j in range(p)],
    )
    ready = written(ready, "placed")
    z = [F.lit(1.0), *[F.col(f"_x{j}") for j in range(p)], F.col("_y")]
    sums = {f"_s{i}_{j}": z[i] * z[j] for i in range(p + 2) for j in range(i, p + 2)}
    whole = sum((F.col(f"_x{j}").isNull().cast("int") for j in range(p)), F.col("_y").isNull().cast("int")) == 0
    cells = [f"_c{j}" for j in range(p)]
    grid = ready.groupBy("symbol", "_known", *cells).agg(F.count("*").alias("_n"), *[F.coalesce(F.sum(F.when(whole, v)), F.lit(0.0)).alias(n) for n, v in sums.items()])
    grid = written(grid, "cell-sums")
    block = F.floor((F.col("step") - 1) / rows)
    asked = ready.where("split = 'test'").withColumn("_block", block)
    edges = written(_edges(grid, asked.select("symbol", "_block").distinct(), p, limits, rows), "bound-cells")

    states = [_state(f"_c{j}", j) for j in range(p)]
    vector = F.array(*[F.col(f"_x{j}") for j in range(p)])
    none, no_states = F.lit(None).cast("double"), F.array().cast("array<int>")

    def events(df: DataFrame, kind: int, at: Column, x: Column, y: Column, state: Column) -> DataFrame:
        return df.select("symbol", "_block", F.lit(kind).alias("kind"), at.cast("long").alias("at"), x.alias("x"), y.alias("y"), state.alias("state"))

    settled = grid.join(edges, "symbol").where("_known <= _block").select("symbol", "_block", *sums, F.array(*states).alias("_state"))
    settled = settled.where(~F.array_contains("_state", OPEN)).groupBy("symbol", "_block", "_state").agg(*[F.sum(n).alias(n) for n in sums])
    shipped = None
    for j in range(p):  # a row goes with the first of its columns whose cell is open
        spans = [F.sequence(F.greatest(f"_{k}_from{j}", F.lit(0)).cast("int"), F.least(f"_{k}_to{j}", F.lit(side**2 - 1)).cast("int")) for k in ("lo", "hi")]
        open_cells = edges.withColumn(f"_c{j}", F.explode(F.array_distinct(F.concat(*spans))))
        met = ready.join(open_cells, ["symbol", f"_c{j}"]).where("_known <= _block").withColumn("_state", F.array(*states))
        met = met.where(F.array_position("_state", OPEN) == j + 1)
        shipped = met if shipped is None else shipped.unionByName(met)
    inside = ready.withColumn("_block", F.floor((F.col("_at") - 1) / rows)).where("_known > _block").join(edges.select("symbol", "_block"), ["symbol", "_block"])
    counts = F.array(*[F.col(f"_{k}{j}").cast("double") for j in range(p) for k in ("lo_below", "hi_above", "all")])
    together = (
        events(settled, 0, F.lit(0), F.array(*[F.col(n) for n in sums]), none, F.col("_state"))
        .unionByName(events(shipped, 1, F.lit(0), vector, F.col("_y"), F.col("_state")))
        .unionByName(events(inside, 2, F.col("_at"), vector, F.col("_y"), no_states))
        .unionByName(events(asked, 3, F.col("step"), vector, F.col("_level"), no_states))
        .unionByName(events(edges, 4, F.lit(0), counts, none, no_states))
    )

    def advance(frame: pd.DataFrame) -> pd.DataFrame:
        parts = {k: g for k, g in frame.groupby("kind")}
        ask = parts[3].sort_values("at")

        def matrix(kind: int, column: str, width: int) -> np.ndarray:
            return np.array(parts[kind][column].tolist(), float).reshape(-1, width) if kind in parts else np.empty((0, width))

        early, late, wanted = matrix(1, "x", p), matrix(2, "x", p), np.array(ask["x"].tolist(), float).reshape(-1, p)
        state, totals = matrix(1, "state", p), matrix(4, "x", 3 * p).reshape(p, 3)
        ys = [parts[k]["y"].to_numpy(float) if k in parts else np.empty(0) for k in (1, 2)]
        known = parts[2]["at"].to_numpy() if 2 in parts else np.empty(0, np.int64)
        steps = ask["at"].to_numpy()
        bounds = np.stack([step_bounds(steps, known, late[:, j], early[:, j], state[:, j], totals[j], limits) for j in range(p)], axis=1)
        patterns = {tuple(int(v) for v in s): _unpack(np.asarray(m, float)) for s, m in zip(parts[0]["state"], parts[0]["x"], strict=True)} if 0 in parts else {}
        full = clipped_sums(steps, bounds, patterns, np.vstack([early, late]), np.concatenate(ys), np.concatenate([np.zeros(len(early), np.int64), known]))
        made = _forecasts(full, np.clip(wanted, bounds[:, :, 0], bounds[:, :, 1])) + ask["y"].to_numpy(float)
        return pd.DataFrame({"symbol": frame["symbol"].iloc[0], "step": steps, "predicted": made})

    made = together.groupBy("symbol", "_block").applyInPandas(advance, "symbol string, step long, predicted double")
    made = made.withColumn("predicted", F.when(~F.isnan("predicted"), F.col("predicted")))
    return keep.where("split = 'test'").join(made, ["symbol", "step"])
