"""Layout of one picture's points: forces and removal of overlaps. Sequential by nature; a picture has a few thousand points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# What a picture looks like.
ROUNDS, SAMPLES, REPULSION, GRAVITY, START_TEMP = 400, 16, 1.5e-5, 0.05, 0.06
SWEEPS = 48
MOST_POINTS = 20_000
"""Points of one picture; more than that no screen shows, and the driver does not gather them."""


def one_picture(points: DataFrame) -> pd.DataFrame:
    """The points (id, ...) of a picture on the driver, by id; an error if there are too many."""
    got = points.limit(MOST_POINTS + 1).toPandas()
    if len(got) > MOST_POINTS:
        raise ValueError(f"a picture has at most {MOST_POINTS} points; select some first")
    return got.sort_values("id", ignore_index=True)


class Lcg:
    """A 64-bit linear congruential generator, so that pictures never change between runs."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFFFFFFFFFF

    def next(self) -> int:
        self.state = (self.state * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
        return self.state >> 33

    def unit(self) -> float:
        return self.next() / (1 << 31)


def _spread(c: np.ndarray, rng: Lcg) -> np.ndarray:
    low, high = c.min(), c.max()
    return (c - low) / (high - low) if high - low > 1e-12 else np.array([rng.unit() for _ in c])


def layout(seeds: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Positions in [0, 1]^2: springs along weighted edges, sampled repulsion, gravity to the centre, cooled over fixed rounds.

    No points give none, one point stands in the middle.
    """
    n = len(seeds)
    if n < 2:
        return np.full((n, 2), 0.5)
    rng = Lcg(0x9E3779B97F4A7C15)
    p = np.stack([_spread(seeds[:, 0], rng), _spread(seeds[:, 1], rng)], axis=1)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, w in edges:
        near[i].append((j, w))
    ends = [np.array([j for j, _ in x], int) for x in near]
    weights = [np.array([w for _, w in x]) for x in near]
    scale = REPULSION * n / SAMPLES
    samples = np.array([rng.next() for _ in range(n * SAMPLES)]).reshape(n, SAMPLES)
    for t in range(ROUNDS):
        temp = START_TEMP * (1 - t / ROUNDS) + 1e-4
        centre = p.mean(0)
        for i in range(n):
            force = (centre - p[i]) * GRAVITY
            if len(ends[i]):
                force = force + (weights[i][:, None] * (p[ends[i]] - p[i])).sum(0)
            away = p[i] - p[(samples[i] + t * 7919) % n]
            d2 = (away * away).sum(1)
            far = d2 > 1e-12
            force = force + (away[far] * (scale / np.maximum(d2[far], 1e-6))[:, None]).sum(0)
            size = float(np.hypot(*force))
            p[i] += force * (min(size, temp) / size if size > 0 else 0)
    low, high = p.min(0), p.max(0)
    return np.where(high - low > 1e-12, (p - low) / np.maximum(high - low, 1e-12), 0.5)


def layout_frame(rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """``layout`` of frames (id, pca) and (i, j, w) as (id, x, y), whatever the order of their rows."""
    rows = rows.sort_values("id")
    place = {i: n for n, i in enumerate(rows["id"])}
    e = sorted((place[i], place[j], float(w)) for i, j, w in zip(edges["i"], edges["j"], edges["w"], strict=True))
    seeds = np.stack(rows["pca"].to_numpy())[:, :2] if len(rows) else np.zeros((0, 2))
    xy = layout(seeds, e)
    return pd.DataFrame({"id": rows["id"].to_numpy(), "x": xy[:, 0], "y": xy[:, 1]})


def relax(p: np.ndarray, radius: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Pushes overlapping discs apart by half the deficit each, within [0, 1]^2, over a grid; stops once nothing moved."""
    p = p.astype(float).copy()
    if len(p) < 2:
        return p
    cell = 2 * float(radius.max())
    for _ in range(sweeps):
        grid: dict[tuple[int, int], list[int]] = {}
        for i, (x, y) in enumerate(p):
            grid.setdefault((int(x / cell), int(y / cell)), []).append(i)
        moved = False
        for (cx, cy), own in sorted(grid.items()):
            around = [j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in grid.get((cx + dx, cy + dy), ())]
            for i in own:
                for j in around:
                    if j <= i:
                        continue
                    dx, dy = p[j] - p[i]
                    d = float(np.hypot(dx, dy))
                    lack = radius[i] + radius[j] - d
                    if lack <= 1e-9:
                        continue
                    if d < 1e-12:
                        angle = ((i * 2654435761 + j * 40503) % 65536) / 65536 * 2 * np.pi
                        dx, dy, d = np.cos(angle), np.sin(angle), 1.0
                    push = np.array([dx, dy]) / d * lack / 2
                    p[i], p[j] = np.clip(p[i] - push, 0, 1), np.clip(p[j] + push, 0, 1)
                    moved = True
        if not moved:
            break
    return p
