"""Runs stages in order with a retry policy for each, one run at a time."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Stage:
    name: str
    work: Callable[[str], object]
    retries: int | None = None
    wait_s: float = 0.0
    after: tuple[str, ...] = ()


#: Retries of the batch job's stages, where a stage names none.
DEFAULT_RETRIES = {"bronze": 2, "silver": 1, "history": 1, "gold": 1, "reconciliation": 0}


def run(stages: list[Stage], run_id: str | None = None) -> dict[str, dict]:
    """Each stage gets the run id; the first that fails beyond its retries stops the run.

    Hold ``sources.files.exclusive`` around it where a second run must be refused.
    """
    run_id, done = run_id or uuid.uuid4().hex, {}
    for stage in stages:
        if missing := [a for a in stage.after if a not in done]:
            raise ValueError(f"{stage.name} stands before {missing}")
        began = time.time()
        retries = DEFAULT_RETRIES.get(stage.name, 0) if stage.retries is None else stage.retries
        for attempt in range(1, retries + 2):
            try:
                result = stage.work(run_id)
                break
            except Exception:
                if attempt > retries:
                    raise
                time.sleep(stage.wait_s)
        done[stage.name] = {"attempts": attempt, "seconds": time.time() - began, "result": result}
    return done
