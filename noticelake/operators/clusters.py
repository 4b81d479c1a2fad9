"""k-means of many parts and many starts at once: every Lloyd step is one aggregation over all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticelake.storage import cut, drop

_STEP = "part int, start int, centre int, n long, loss double, total array<double>"


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _spread(points: np.ndarray, counts: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` first centres among unlike points, of which there are so many each: some are drawn by their squared distance to those before, the best of them stays."""
    draw, upto = np.random.default_rng(seed), np.cumsum(counts)
    any_of = lambda size: np.searchsorted(upto, draw.integers(upto[-1], size=size), side="right")
    chosen = [points[any_of(None)]]
    away = ((points - chosen[0]) ** 2).sum(1)
    tries = 2 + int(np.log(k))
    while len(chosen) < k:
        total = (away * counts).sum()
        drawn = draw.choice(len(points), size=tries, p=away * counts / total) if total > 0 else any_of(1)
        left = [np.minimum(away, ((points - points[i]) ** 2).sum(1)) for i in drawn]
        best = min(range(len(drawn)), key=lambda i: (left[i] * counts).sum())
        chosen.append(points[drawn[best]])
        away = left[best]
    return np.array(chosen)


def _numbered(rows: DataFrame, part: str, parts: list) -> DataFrame:
    """Rows of the parts, with their numbers."""
    kind = rows.schema[part].dataType.simpleString()
    numbers = rows.sparkSession.createDataFrame([(p, i) for i, p in enumerate(parts)], f"`{part}` {kind}, __pn int")
    return rows.join(F.broadcast(numbers), part)


def _classes(numbered: DataFrame, vector: str) -> DataFrame:
    """The unlike vectors of every part, each with ``__n``, the rows that have it."""
    return cut(numbered.groupBy("__pn", vector).agg(F.count("*").alias("__n")), "unlike-vectors")


def _first(classes: DataFrame, vector: str, parts: int, sample: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of every part the ``sample`` unlike vectors with the smallest hashes, and their counts: starts are drawn from these.

    Equal vectors have equal hashes, so shares are those of unlike ones: of rows that share few vectors none might be drawn. A part of
    up to four samples gives its first ``sample`` rows, equal ones among them; in larger ones these may all be equal.
    """
    sizes = {r["__pn"]: r for r in classes.groupBy("__pn").agg(F.count("*").alias("unlike"), F.sum("__n").alias("rows")).collect()}
    shares = F.array(*[F.lit(min(1.0, 4 * sample / sizes[i]["unlike"])) for i in range(parts)])
    hashed = classes.withColumn("__h", F.pmod(F.xxhash64(vector), F.lit(1 << 31))).where(F.col("__h") < F.get(shares, F.col("__pn")) * (1 << 31))
    order = W.partitionBy("__pn").orderBy("__h", vector)
    ranked = hashed.withColumns({"__at": F.row_number().over(order), "__upto": F.sum("__n").over(order)}).where(F.col("__at") <= sample)
    few = F.get(F.array(*[F.lit(sizes[i]["rows"] <= 4 * sample) for i in range(parts)]), F.col("__pn"))
    ranked = ranked.withColumn("__n", F.when(few, F.least("__n", sample - F.col("__upto") + F.col("__n"))).otherwise(F.col("__n"))).where("__n > 0")
    found = ranked.select("__pn", "__n", "__at", vector).orderBy("__pn", "__at").toArrow()
    pn, n, v = found["__pn"].to_numpy(), found["__n"].to_numpy(), _rows(found[vector].combine_chunks())
    return [(v[pn == i], n[pn == i]) for i in range(parts)]


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every row, for each start: its centre and the squared distance."""
    starts, k, d = centres.shape
    away = (x * x).sum(1)[:, None] - 2 * x @ centres.reshape(-1, d).T + (centres * centres).sum(2).reshape(-1)[None, :]
    away = away.reshape(len(x), starts, k)
    at = away.argmin(2)
    return at, np.maximum(np.take_along_axis(away, at[:, :, None], 2)[:, :, 0], 0.0)


def _step(classes: DataFrame, vector: str, centres: dict[int, np.ndarray]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, float]]:
    """One pass: per part and start the counts and sums of its centres, and the inertia. A vector counts as often as rows have it.

    A task adds up its rows and sends one row per centre, however many rows it has.
    """
    d = next(iter(centres.values())).shape[2]

    def added(batches):
        held: dict[int, list] = {}
        for batch in batches:
            pn, times, x = batch["__pn"].to_numpy(), batch["__n"].to_numpy(), _rows(batch[vector]) if batch.num_rows else None
            for p in np.unique(pn):
                c = centres[p]
                if p not in held:
                    held[p] = [np.zeros(c.shape[:2], np.int64), np.zeros(c.shape[:2]), np.zeros(c.shape)]
                n, loss, total = held[p]
                mine, often = x[pn == p], times[pn == p]
                for lo in range(0, len(mine), 4096):
                    some, w = mine[lo : lo + 4096], often[lo : lo + 4096]
                    at, away = _nearest(some, c)
                    for s in range(len(c)):
                        np.add.at(n[s], at[:, s], w)
                        loss[s] += np.bincount(at[:, s], away[:, s] * w, c.shape[1])
                        np.add.at(total[s], at[:, s], some * w[:, None])
        for p, (n, loss, total) in held.items():
            starts, k = n.shape
            sums = pa.ListArray.from_arrays(pa.array(np.arange(starts * k + 1) * d, pa.int32()), pa.array(total.reshape(-1)))
            s, c = np.divmod(np.arange(starts * k), k)
            columns = [np.full(starts * k, p, np.int32), s.astype(np.int32), c.astype(np.int32), n.reshape(-1), loss.reshape(-1)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), sums], names=["part", "start", "centre", "n", "loss", "total"])

    asked = classes.where(F.col("__pn").isin(*map(int, centres))).select("__pn", "__n", vector)
    sums = [F.sum(F.get("total", F.lit(i))).alias(f"x{i}") for i in range(d)]
    found = asked.mapInArrow(added, _STEP).groupBy("part", "start", "centre").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), *sums).toArrow()
    out = {}
    part, start, centre = (found[c].to_numpy() for c in ("part", "start", "centre"))
    n, loss = found["n"].to_numpy(), found["loss"].to_numpy()
    total = np.stack([found[f"x{i}"].to_numpy() for i in range(d)], 1)
    for p, c in centres.items():
        for s in range(len(c)):
            at = (part == p) & (start == s)
            order = np.argsort(centre[at])
            out[p, s] = n[at][order], total[at][order], float(loss[at].sum())
    return out


def fit(rows: DataFrame, part: str, vector: str, sizes: dict, k: int, seeds: tuple[int, ...], iterations: int = 20, tolerance: float = 1e-4, sample: int = 1024) -> dict:
    """Centres of the best start and their inertia, for every part of ``sizes``, which gives its counted rows.

    The first centres of a start are spread over a sample of ``sample`` unlike vectors of the part; all steps use all rows, equal
    ones as one. A step is one job for every part and start that still moves by more than ``tolerance``. What comes to the driver are
    the centres, ``parts * starts * k`` vectors, whatever the rows. A centre that loses all its rows stays.
    """
    parts = list(sizes)
    classes = _classes(_numbered(rows, part, parts), vector)
    drawn = _first(classes, vector, len(parts), sample)
    centres = {(i, s): _spread(points, counts, k, seed) for i, (points, counts) in enumerate(drawn) for s, seed in enumerate(seeds)}
    moving = set(centres)

    def step(keys) -> dict:
        by = {}
        for i, s in sorted(keys):
            by.setdefault(i, []).append(s)
        found = _step(classes, vector, {i: np.stack([centres[i, s] for s in starts]) for i, starts in by.items()})
        return {(i, s): found[i, at] for i, starts in by.items() for at, s in enumerate(starts)}

    for _ in range(iterations):
        if not moving:
            break
        for at, (n, total, _) in step(moving).items():
            fresh = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres[at])
            if np.linalg.norm(fresh - centres[at], axis=1).max() <= tolerance:
                moving.discard(at)
            centres[at] = fresh
    losses = {at: loss for at, (_, _, loss) in step(centres).items()}
    drop(classes)
    # starts that end in the same centres differ in the last digits only: the first of them counts in every run
    best = {i: min(range(len(seeds)), key=lambda s, i=i: (float(f"{losses[i, s]:.9g}"), s)) for i in range(len(parts))}
    return {p: (centres[i, best[i]], losses[i, best[i]]) for i, p in enumerate(parts)}


def assign(rows: DataFrame, key: str, part: str, vector: str, centres: dict) -> DataFrame:
    """``key``, ``part``, ``theme`` and the cosine to its centre, of the rows of the parts with centres."""
    numbered = _numbered(rows, part, list(centres)).select(key, part, "__pn", vector)
    held = list(centres.values())

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pn, x = batch["__pn"].to_numpy(), _rows(batch[vector])
            theme, like = np.zeros(len(pn), np.int32), np.zeros(len(pn))
            for p in np.unique(pn):
                here = np.flatnonzero(pn == p)
                theme[here] = _nearest(x[here], held[p][None])[0][:, 0]
                c = held[p][theme[here]]
                size = np.linalg.norm(x[here], axis=1) * np.linalg.norm(c, axis=1)
                like[here] = np.divide((x[here] * c).sum(1), size, out=np.zeros(len(here)), where=size > 0)
            yield pa.RecordBatch.from_arrays([batch[key], batch[part], pa.array(theme), pa.array(like)], names=[key, part, "theme", "similarity"])

    kind = lambda c: f"`{c}` {rows.schema[c].dataType.simpleString()}"
    return numbered.mapInArrow(place, f"{kind(key)}, {kind(part)}, theme int, similarity double")
