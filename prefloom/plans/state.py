"""Loops that can stop and go on: each step's arrays and facts, kept in a folder that all machines share.

``Loop.run`` takes a step function of (number, state) alone, so that a run that is resumed after step k gives what an
unbroken one gives.  A step counts as kept once its table is committed; what a lost driver left half-written is not
read.  Without a folder only the facts are kept, in memory.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession

SCHEMA = "name string, shape array<int>, place long, value double"


class Loop:
    """Runs until ``fact`` of a step falls below ``eps``, or ``iters`` steps; ``history`` lists each step's facts."""

    def __init__(self, iters: int, eps: float = 0.0, spark: SparkSession | None = None, at: str | None = None, fact: str = "change"):
        self.iters, self.eps, self.spark, self.fact = iters, eps, spark, fact
        self.at = at.rstrip("/") if at else None
        self.history: list[dict[str, float]] = []

    def run(self, start: dict[str, np.ndarray], step: Callable[[int, dict[str, np.ndarray]], tuple[dict[str, np.ndarray], dict[str, float]]]) -> dict[str, np.ndarray]:
        k, state = self.resume() or (0, start)
        while k < self.iters and not self.settled():
            state, facts = step(k, state)
            k += 1
            self.history.append(facts)
            if self.at:
                self._keep(k, state, facts)
        return state

    def settled(self) -> bool:
        return bool(self.history) and self.history[-1].get(self.fact, np.inf) < self.eps

    def resume(self) -> tuple[int, dict[str, np.ndarray]] | None:
        """(steps made, state after them) of what the folder holds; the history is read too."""
        if not self.at or not (steps := self._steps()):
            return None
        facts = self.spark.read.schema(f"{SCHEMA}, step long").option("basePath", self.at).parquet(*[f"{self.at}/step={k}" for k in steps])
        by_step: dict[int, dict[str, float]] = {k: {} for k in steps}
        for r in facts.where("shape is null").collect():  # a few numbers a step
            by_step[r.step][r.name] = r.value
        self.history = [by_step[k] for k in steps]
        state: dict[str, np.ndarray] = {}
        for r in self.spark.read.schema(SCHEMA).parquet(f"{self.at}/step={steps[-1]}").where("shape is not null").collect():
            state.setdefault(r.name, np.zeros(tuple(r.shape))).reshape(-1)[r.place] = r.value
        return steps[-1], state

    def clear(self) -> None:
        """Forgets all steps."""
        self.history = []
        if self.at:
            path = self._path(self.at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at)

    def _steps(self) -> list[int]:
        path = self._path(f"{self.at}/step=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(x.getPath().getParent().getName().removeprefix("step=")) for x in found)

    def _keep(self, k: int, state: dict[str, np.ndarray], facts: dict[str, float]) -> None:
        rows = [(name, list(x.shape), i, float(v)) for name, x in state.items() for i, v in enumerate(np.asarray(x, float).ravel())]
        rows += [(name, None, 0, float(v)) for name, v in facts.items()]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.at}/step={k}")
