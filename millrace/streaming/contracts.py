"""The submission contract as a stream: each sequence's state is kept between batches, a verdict comes out at
its closing step."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "cmds int, ready boolean, empty boolean, fresh boolean, steps int, verdict string, rule string"
OUTPUT = "sequence string, judgment string, contract string, steps int"


def _step(s: tuple, op: str, reg: str, ready: bool, empty: bool, max_steps: int) -> tuple:
    """One step of the state machine: (cmds, ready, empty, fresh, steps, verdict, rule)."""
    cmds, was_ready, was_empty, fresh, steps, verdict, rule = s
    if verdict:
        return s
    after = steps + 1
    stop = lambda v, r: (cmds, was_ready, was_empty, fresh, after, v, r)
    if steps >= max_steps:
        return stop("BUDGET_INFEASIBLE", "")
    if op not in ("read", "write"):
        return stop("VIOLATION", "UNKNOWN_OP")
    if op == "read" and reg == "STATUS":
        return cmds, ready, empty, fresh or (ready and cmds >= 2), after, "", ""
    if op == "write" and reg == "COMMAND":
        if cmds < 2 and not was_ready:
            return stop("VIOLATION", "S1")
        if cmds >= 2 and not fresh:
            return stop("VIOLATION", "S3")
        return cmds + 1, was_ready, was_empty, False, after, "", ""
    return cmds, was_ready, was_empty, fresh, after, "", ""


def check_stream(steps: DataFrame, segments: int = 3, max_steps: int = 200) -> DataFrame:
    """steps (sequence, at, op, reg, ready, empty, last): rows of a sequence may come in any number of
    batches, in order between batches and sorted by ``at`` within one; ``last`` closes the sequence."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = tuple(state.get) if state.exists else (0, False, False, False, 0, "", "")
        closed = False
        rows = pd.concat(list(frames)).sort_values("at")
        for r in rows.itertuples():
            s = _step(s, r.op, r.reg, bool(r.ready), bool(r.empty), max_steps)
            closed |= bool(r.last)
        if not closed:
            state.update(s)
            yield pd.DataFrame(columns=["sequence", "judgment", "contract", "steps"])
            return
        state.remove()
        cmds, ready, empty, _, n, verdict, rule = s
        if not verdict:
            verdict, rule = ("INSUFFICIENT_EVIDENCE", "") if cmds < segments else ("SUCCESS", "") if ready and empty else ("VIOLATION", "S7")
        yield pd.DataFrame([(key[0], verdict, rule or None, n)], columns=["sequence", "judgment", "contract", "steps"])

    return steps.groupBy("sequence").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
