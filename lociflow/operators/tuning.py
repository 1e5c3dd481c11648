"""Settings by a tree-structured Parzen sampler: what good trials have in common is drawn more often, by setting.

A space gives each setting a list of values or a range (low, high), or (low, high, "log") for one whose order of magnitude counts. The best
tenth of the trials so far is the good ones. Of a list, values are weighed by how often each side took them, with one for each beforehand; of a range, a side's
density is a kernel around each of its values and a wide one over the range. CANDIDATES are drawn from the good side's; the one whose good density
is largest against the other side's is tried. A trial draws from (seed, trial), and sees the rounds before its own: trials of a round run side by side, in
scheduler pools of their own, and the history is the same however they are timed.
"""

from __future__ import annotations

import json
import math
import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

STARTUP, CANDIDATES, GOOD, MOST_GOOD = 8, 24, 0.1, 25
HISTORY = "trial int, params string, objective double, seconds double, measures string"


def _line(spec: tuple) -> tuple[float, float, Callable, Callable]:
    """A range as (low, high) on the line it is searched on, and the ways there and back."""
    low, high, *how = spec
    there, back = (math.log, math.exp) if how == ["log"] else (float, float)
    return there(low), there(high), there, back


class _List:
    def __init__(self, values: list, taken: list):
        self.values = values
        self.weights = [1 + sum(t == v for t in taken) for v in values]

    def draw(self, rng: random.Random):
        return rng.choices(self.values, self.weights)[0]

    def density(self, value) -> float:
        return self.weights[self.values.index(value)] / sum(self.weights)


class _Range:
    def __init__(self, spec: tuple, taken: list):
        self.low, self.high, self.there, self.back = _line(spec)
        self.at = sorted(map(self.there, taken))
        # A kernel is as wide as the wider gap beside its value, so it narrows where values gather.
        gaps = [b - a for a, b in zip(self.at, self.at[1:])]
        span, least = self.high - self.low, (self.high - self.low) / min(100, 1 + 2 * len(self.at))
        wider = [max(a, b) for a, b in zip([0.0, *gaps], [*gaps, 0.0])] if gaps else [span / 2] * len(self.at)
        self.width = [min(span, max(least, g)) for g in wider]

    def draw(self, rng: random.Random):
        i, at = rng.randrange(-1, len(self.at)), rng.uniform(self.low, self.high)
        if i >= 0:
            at = rng.gauss(self.at[i], self.width[i])
        return self.back(min(self.high, max(self.low, at)))

    def density(self, value) -> float:
        x, own = self.there(value), 1 / (self.high - self.low)
        near = sum(math.exp(-(((x - c) / w) ** 2) / 2) / (w * math.sqrt(2 * math.pi)) for c, w in zip(self.at, self.width))
        return (own + near) / (1 + len(self.at))


def suggest(space: dict, history: list[tuple[dict, float]], seed: int, trial: int, startup: int = STARTUP) -> dict:
    """The settings of a trial, after a history of (settings, objective); larger objectives are better."""
    rng = random.Random(f"{seed}:{trial}")
    known = [(p, o) for p, o in history if o is not None and not math.isnan(o)]
    ranked = [p for p, _ in sorted(known, key=lambda h: -h[1])] if len(known) >= startup else []
    n = min(MOST_GOOD, math.ceil(GOOD * len(ranked)))
    chosen = {}
    for name, spec in sorted(space.items()):
        kind = _List if isinstance(spec, list) else _Range
        good, rest = (kind(spec, [p[name] for p in part]) for part in (ranked[:n], ranked[n:]))
        drawn = [good.draw(rng) for _ in range(CANDIDATES if ranked else 1)]
        chosen[name] = max(drawn, key=lambda v: good.density(v) / rest.density(v))
    return chosen


def tune(spark: SparkSession, objective: Callable[[dict], float | tuple[float, dict]], space: dict, n: int, seed: int = 42, parallel: int = 4, startup: int = STARTUP) -> list[tuple]:
    """Rows of HISTORY for n trials: `parallel` of them make a round. The objective gives a number, or one and measures to keep beside it."""
    rows: list[tuple] = []
    history: list[tuple[dict, float]] = []

    def run(trial: int, params: dict) -> tuple:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{trial % parallel}")
        began = time.time()
        found = objective(params)
        value, measures = found if isinstance(found, tuple) else (found, {})
        return trial, json.dumps(params), float(value), time.time() - began, json.dumps(measures)

    with ThreadPoolExecutor(parallel) as pool:
        for first in range(0, n, parallel):
            trials = range(first, min(n, first + parallel))
            settings = [suggest(space, history, seed, t, startup) for t in trials]
            done = list(pool.map(inheritable_thread_target(spark)(run), trials, settings))
            rows += done
            history += [(p, r[2]) for p, r in zip(settings, done)]
    return rows
