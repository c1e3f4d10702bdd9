"""Chat formatting with minimum-cost role repair.

Legal order: system at the start if at all, then user and assistant in turn, assistant last. Each turn is kept,
relabelled, or merged into the turn before it, and empty turns are put in where one is missing. Dynamic programming
over the role of the last turn written finds the cheapest repair. A step is a 4 x 4 matrix in (min, +), and matrices of
consecutive turns multiply, so a conversation of any length is cut into pieces of `piece` turns: pieces are reduced to
matrices, a path through the pieces fixes the state between them, and each piece is then repaired alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, MERGE, RELABEL, INSERT = 0, 1, 2, 3
#: Costs of a relabel (of a role that is not one of ROLES: 1), a merge, and an empty turn.
RELABEL_COST, UNKNOWN_COST, MERGE_COST, EMPTY_COST = 2, 1, 1, 3
NEVER = 10**9


def legal(before: int, role: int) -> bool:
    return (before, role) in {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def moves(before: int, said: int) -> list[tuple[int, int, tuple[int, ...], bool]]:
    """(cost, state after, empty roles put in first, merged) for one turn; said is a state of ROLES or 0 for others.

    In the order that ties are settled: keep, merge, relabel, empty turns.
    """
    label = lambda role: 0 if role == said else RELABEL_COST if said else UNKNOWN_COST
    out = []
    if before != START:
        out.append((MERGE_COST + label(before), before, (), True))
    for role in (SYSTEM, USER, ASSISTANT):
        if legal(before, role):
            out.append((label(role), role, (), False))
        else:
            for empty in (USER, ASSISTANT):
                if legal(before, empty) and legal(empty, role):
                    out.append((label(role) + EMPTY_COST, role, (empty,), False))
    order = lambda m: (m[0], len(m[2]) > 0, m[1] != said and not m[3], m[3])
    return sorted(out, key=order)


#: Cost of what must follow the last turn.
CLOSING = {START: 0, SYSTEM: 2 * EMPTY_COST, USER: EMPTY_COST, ASSISTANT: 0}
CLOSERS = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
MOVES = {(b, s): moves(b, s) for b in range(4) for s in range(4)}
STEP = np.full((4, 4, 4), NEVER, np.int64)
for (_b, _s), _all in MOVES.items():
    for _cost, _after, _, _ in _all:
        STEP[_s, _b, _after] = min(STEP[_s, _b, _after], _cost)


def code_of(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else 0


def product(codes: list[int]) -> np.ndarray:
    """Cheapest cost from each state to each, over these turns."""
    total = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for c in codes:
        total = np.minimum((total[:, :, None] + STEP[c][None]).min(1), NEVER)
    return total


def path(matrices: list[np.ndarray]) -> list[int]:
    """States before, between and after pieces on a cheapest path from START to a legal end; ties to lower states."""
    cost = [np.where(np.arange(4) == START, 0, NEVER)]
    for m in matrices:
        cost.append(np.minimum((cost[-1][:, None] + m).min(0), NEVER))
    state = int(np.argmin(cost[-1] + np.array([CLOSING[s] for s in range(4)])))
    states = [state]
    for m, c in zip(reversed(matrices), reversed(cost[:-1]), strict=True):
        state = int(np.argmin(c + m[:, state]))
        states.append(state)
    return states[::-1]


def repair(codes: list[int], entry: int = START, leave: int | None = None) -> list[tuple[int, tuple[int, ...], bool]]:
    """(role, empty roles put in before it, merged) for each turn, from state entry to leave (None: a legal end)."""
    cost = [{entry: 0}]
    back: list[dict[int, tuple[int, tuple]]] = []
    for c in codes:
        now: dict[int, int] = {}
        how: dict[int, tuple[int, tuple]] = {}
        for before in sorted(cost[-1]):
            for move in MOVES[before, c]:
                total = cost[-1][before] + move[0]
                if total < now.get(move[1], NEVER):
                    now[move[1]], how[move[1]] = total, (before, move)
        cost.append(now)
        back.append(how)
    state = leave if leave is not None else min(sorted(cost[-1]), key=lambda s: cost[-1][s] + CLOSING[s])
    out = []
    for how in reversed(back):
        before, move = how[state]
        out.append((move[1], move[2], move[3]))
        state = before
    return out[::-1]


def repaired(turns: DataFrame, piece: int = 512, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, seq, action, role, text, inserted, closing) for each row of turns.

    seq numbers a conversation's rows by turn (ties by role and text, nulls first). action is keep, merge or relabel;
    role is what the turn becomes (of a merge: the turn it joins); inserted lists empty roles before it, closing those
    after a conversation's last row. Roles are read without case and outer blanks; null and other roles are relabelled.
    Null texts are empty. Rows of null conv_id are one conversation. Extra columns are ignored; no rows give no rows.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("said"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "said", "text")
    rows = rows.withColumn("seq", (F.row_number().over(order) - 1).cast("long")).withColumn("piece", F.floor(F.col("seq") / F.lit(piece)))

    def reduce_piece(pdf: pd.DataFrame) -> pd.DataFrame:
        m = product([code_of(r) for r in pdf.sort_values("seq")["said"]])
        return pd.DataFrame({"conv_id": [pdf["conv_id"].iloc[0]], "piece": [pdf["piece"].iloc[0]], "matrix": [m.ravel().tolist()]}).astype({"conv_id": "Int64"})

    def through(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece")
        states = path([np.array(m).reshape(4, 4) for m in pdf["matrix"]])
        last = pdf["piece"].max()
        leave = [s if p != last else -1 for s, p in zip(states[1:], pdf["piece"], strict=True)]
        return pd.DataFrame({"conv_id": pdf["conv_id"].astype("Int64"), "piece": pdf["piece"], "entry": states[:-1], "leave": leave})

    long = rows.groupBy("conv_id").agg(F.max("piece").alias("last")).where("last > 0").select(F.col("conv_id").alias("long_id"))
    pieces = rows.join(long, rows["conv_id"].eqNullSafe(long["long_id"]), "left_semi").select("conv_id", "piece", "seq", "said")
    pieces = pieces.groupBy("conv_id", "piece").applyInPandas(reduce_piece, "conv_id long, piece long, matrix array<long>")
    states = pieces.groupBy("conv_id").applyInPandas(through, "conv_id long, piece long, entry int, leave int")
    met = rows.alias("r").join(states.alias("s"), F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("r.piece") == F.col("s.piece")), "left")
    met = met.select("r.*", F.coalesce("entry", F.lit(START)).alias("entry"), F.coalesce("leave", F.lit(-1)).alias("leave"))

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(b):
                continue
            new = (b["seq"] % piece == 0).to_numpy()  # a piece starts
            starts = np.flatnonzero(new)
            held = b.iloc[starts[-1] :]
            if starts[-1]:
                yield fixed(b.iloc[: starts[-1]], starts[:-1])
        if held is not None and len(held):
            yield fixed(held, np.array([0]))

    def fixed(b: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        said, entry, leave = b["said"].tolist(), b["entry"].tolist(), b["leave"].tolist()
        action, role, inserted, closing = [], [], [], []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(b)], strict=True):
            codes = [code_of(x) for x in said[lo:hi]]
            done = repair(codes, entry[lo], None if leave[lo] < 0 else leave[lo])
            for c, (state, empty, merged) in zip(codes, done, strict=True):
                action.append("merge" if merged else "keep" if c == state else "relabel")
                role.append(ROLES[state - 1])
                inserted.append([ROLES[e - 1] for e in empty])
                closing.append([])
            if leave[lo] < 0:
                closing[-1] = [ROLES[e - 1] for e in CLOSERS[done[-1][0]]]
        return pd.DataFrame({"conv_id": b["conv_id"].astype("Int64"), "turn": b["turn"].astype("Int64"), "seq": b["seq"], "action": action, "role": role, "text": b["text"], "inserted": inserted, "closing": closing})

    dealt = met.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "seq")
    return dealt.select("conv_id", "turn", "said", "text", "seq", "entry", "leave").mapInPandas(fix, "conv_id long, turn long, seq long, action string, role string, text string, inserted array<string>, closing array<string>")


def rendered(rows: DataFrame, open_mark: str = "<|{}|>\n", close_mark: str = "<|end|>\n") -> DataFrame:
    """repaired()'s rows with `chunk`: what the row adds to its conversation, which is its chunks joined by seq.

    A merged text follows the text before it on a new line; a turn's close mark is part of what follows it.
    """
    opened = lambda role: F.concat(F.lit(open_mark.split("{}")[0]), role, F.lit(open_mark.split("{}")[1]))
    empty = lambda roles: F.array_join(F.transform(roles, lambda r: F.concat(opened(r), F.lit(close_mark))), "")
    end = F.when(F.col("seq") > 0, F.lit(close_mark)).otherwise("")
    body = F.when(F.col("action") == "merge", F.concat(F.lit("\n"), "text")).otherwise(F.concat(end, empty(F.col("inserted")), opened(F.col("role")), F.col("text")))
    last = F.lead("seq").over(Window.partitionBy("conv_id").orderBy("seq")).isNull()
    return rows.withColumn("chunk", F.concat(body, F.when(last, F.concat(F.lit(close_mark), empty(F.col("closing")))).otherwise("")))
