"""Chat formatting with minimum-cost role repair.

A conversation is legal if it is an optional system turn and then user and assistant in turns, user first and assistant
last. A dynamic program over the automaton of legal turns picks, for every message, to keep its role, to give it
another, or to merge it into the turn before, and where to insert empty turns, at least total cost. Each message is a
small matrix over the automaton's states in the (min, +) algebra; conversations longer than a block are cut into
blocks whose matrices are combined by a prefix scan, and a block is rendered as a part of its conversation's text, so no
conversation has to fit one task or one string. What one task has of a conversation is a row a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.llm.shared import written

#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Cost of what can't be reached.
FAR = 1 << 40
#: Messages that may share a turn number before their block is split.
TURN_ROWS = 64
#: Stands for a null turn: it comes before all others.
NO_TURN = -(1 << 62)
ROLES = ("", "system", "user", "assistant")
#: Legal next states of each.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Other names of roles that are read as these.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}


@dataclass(frozen=True)
class Costs:
    """In whole numbers, so that sums are exact. A message without a known role takes any at no cost."""

    relabel: int = 10
    merge: int = 4
    insert: int = 7


def inserted_paths(costs: Costs) -> dict[tuple[int, int], tuple[int, tuple[int, ...]]]:
    """For each pair of states the least cost of empty turns that lead from the first to the second, and those turns."""
    best = {(s, s): (0, ()) for s in range(4)}
    for _ in range(4):
        for (a, b), (cost, path) in list(best.items()):
            for c in NEXT[b]:
                found = (cost + costs.insert, (*path, c))
                if (a, c) not in best or found < best[a, c]:
                    best[a, c] = found
    return best


def message_steps(role: str, costs: Costs) -> list[tuple[int, int, int, tuple[int, ...], bool]]:
    """The ways to take a message of the role: (state before, state after, cost, empty turns inserted before, merged)."""
    out = []
    for (a, b), (cost, path) in inserted_paths(costs).items():
        for c in NEXT[b]:
            out.append((a, c, cost + (0 if role in ("", ROLES[c]) else costs.relabel), path, False))
    for s in (SYSTEM, USER, ASSISTANT):
        out.append((s, s, costs.merge + (0 if role in ("", ROLES[s]) else costs.relabel), (), True))
    return out


class Repairer:
    """Best steps by role and pair of states: least cost, then fewest insertions, then not merged, then states in order."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self.best: dict[str, dict[tuple[int, int], tuple[int, tuple[int, ...], bool]]] = {}
        for role in ROLES:
            own: dict[tuple[int, int], tuple[int, tuple[int, ...], bool]] = {}
            for a, b, cost, path, merged in message_steps(role, costs):
                key = (cost, len(path), merged, path)
                if (a, b) not in own or key < (own[a, b][0], len(own[a, b][1]), own[a, b][2], own[a, b][1]):
                    own[a, b] = (cost, path, merged)
            self.best[role] = own
        self.finish = {s: min((cost, path) for (a, b), (cost, path) in inserted_paths(costs).items() if a == s and b == ASSISTANT) for s in range(1, 4)}
        self.matrix = {role: np.array([[own.get((a, b), (FAR,))[0] for b in range(4)] for a in range(4)]) for role, own in self.best.items()}

    def product(self, roles: list[str]) -> np.ndarray:
        """The (min, +) product of the messages' matrices."""
        total = np.where(np.eye(4, dtype=bool), 0, FAR)
        for r in roles:
            total = np.minimum((total[:, :, None] + self.matrix[r][None]).min(axis=1), FAR)
        return total

    def reached(self, roles: list[str], start: int) -> np.ndarray:
        """Least costs of the states after each message, before the first in row 0."""
        reach = np.full((len(roles) + 1, 4), FAR)
        reach[0, start] = 0
        for i, r in enumerate(roles):
            reach[i + 1] = np.minimum((reach[i][:, None] + self.matrix[r]).min(axis=0), FAR)
        return reach

    def end(self, costs: np.ndarray) -> tuple[int, int]:
        """The last state of least total cost, the lesser one of ties, and that cost."""
        last = min(range(1, 4), key=lambda s: (costs[s] + self.finish[s][0], s))
        return last, int(costs[last] + self.finish[last][0])

    def path(self, roles: list[str], start: int, end: int) -> list[int]:
        """States after each message on a least-cost path from start to end; ties go to the lesser state before."""
        reach, states = self.reached(roles, start), [end]
        for i in range(len(roles), 0, -1):
            states.append(int(np.argmin(reach[i - 1] + self.matrix[roles[i - 1]][:, states[-1]])))
        return states[::-1][1:]


def known_role(role: object) -> str:
    """system, user, assistant, or the empty string for what is not a role."""
    name = role.strip().lower() if isinstance(role, str) else ""
    name = ALIASES.get(name, name)
    return name if name in ROLES else ""


def in_blocks(df: DataFrame, conv: str, turn: str, role: str, text: str, block: int) -> DataFrame:
    """conv_id, turn, role, text, order (a hash of role and text), k1, k2, k3 of every message: messages go by turn (null first), then order,
    role and text, and k1, k2, k3 number the blocks of a conversation in that order.

    A block is a range of turns. One in which a turn number is repeated over TURN_ROWS times is split by turns, and such turns by
    ranges of order, so that neither null turns nor a repeated number make a large block; only messages that repeat a turn, a role and a text stay together.
    """
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"order": F.xxhash64("role", "text"), "k1": F.coalesce(F.floor(F.col("turn") / block), F.lit(NO_TURN)), "t": F.coalesce("turn", F.lit(NO_TURN))})
    hot = rows.groupBy(F.col("conv_id").alias("hot_conv"), F.col("k1").alias("hot_k1"), F.col("t").alias("hot_t")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TURN_ROWS)
    zero = F.lit(0).cast("bigint")
    if hot.isEmpty():
        return rows.withColumns({"k2": zero, "k3": zero}).drop("t")
    bits = F.ceil(F.log2(F.col("n") / TURN_ROWS)).cast("int")
    hot = written(hot.withColumn("bits", bits).drop("n"), "hot_turns")
    same = F.col("conv_id").eqNullSafe(F.col("hot_conv")) & (F.col("k1") == F.col("hot_k1"))
    split = rows.join(hot.select("hot_conv", "hot_k1").distinct(), same, "left").withColumn("k2", F.when(F.col("hot_k1").isNotNull(), F.col("t")).otherwise(zero)).drop("hot_conv", "hot_k1")
    split = split.join(hot, same & (F.col("t") == F.col("hot_t")), "left")
    # the highest bits of a signed number keep its order
    ranges = F.when(F.col("bits").isNotNull(), F.floor(F.col("order") / F.pow(F.lit(2.0), F.lit(64) - F.col("bits"))).cast("bigint")).otherwise(zero)
    return split.withColumn("k3", ranges).drop("t", "hot_conv", "hot_k1", "hot_t", "bits")


BLOCK = ["k1", "k2", "k3"]


def solved(df: DataFrame, conv: str, turn: str, role: str, text: str, costs: Costs, block: int, run: Callable, ddl: str) -> DataFrame:
    """run over the blocks, whole and in order, of every conversation, with the states at which the least-cost path enters and leaves each."""
    rows = in_blocks(df, conv, turn, role, text, block)
    repairer = Repairer(costs)
    kind = T.StructType([T.StructField("conv_id", df.schema[conv].dataType)])

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "order"], na_position="first", kind="stable")
        total = repairer.product([known_role(r) for r in pdf["role"]])
        return pd.DataFrame({**{c: pdf[c].iloc[:1] for c in ("conv_id", *BLOCK)}, "product": [total.ravel().tolist()]})

    # conversations of one block, nearly all, need no scan over blocks; of the others only roles and turns move for it
    place = F.struct(*BLOCK)
    several = rows.groupBy("conv_id").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high").select(F.col("conv_id").alias("long_id"))
    slim = rows.select("conv_id", *BLOCK, "turn", "role", "order").join(several, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_semi")
    made = slim.groupBy("conv_id", *BLOCK).applyInPandas(products, T.StructType([*kind.fields, *T.StructType.fromDDL("k1 bigint, k2 bigint, k3 bigint, product array<bigint>").fields]))

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        """From one small row a block: the states at which the least-cost path enters and leaves each."""
        pdf = pdf.sort_values(BLOCK)
        mats = [np.array(p).reshape(4, 4) for p in pdf["product"]]
        reach = [np.array([0, FAR, FAR, FAR])]
        for m in mats:
            reach.append(np.minimum((reach[-1][:, None] + m).min(axis=0), FAR))
        last, total = repairer.end(reach[-1])
        at = [last]
        for i in range(len(mats), 0, -1):
            at.append(int(np.argmin(reach[i - 1] + mats[i - 1][:, at[-1]])))
        at = at[::-1]
        return pd.DataFrame({"long_id": pdf["conv_id"], **{f"long_{c}": pdf[c] for c in BLOCK}, "enter": at[:-1], "leave": at[1:], "cost": total, "final": [False] * (len(mats) - 1) + [True]})

    shape = T.StructType([T.StructField("long_id", df.schema[conv].dataType), *T.StructType.fromDDL("long_k1 bigint, long_k2 bigint, long_k3 bigint, enter int, leave int, cost bigint, final boolean").fields])
    ends = made.groupBy("conv_id").applyInPandas(states, shape)
    on = F.col("conv_id").eqNullSafe(F.col("long_id"))
    for c in BLOCK:
        on &= F.col(c) == F.col(f"long_{c}")
    joined = rows.join(ends, on, "left").drop("long_id", *[f"long_{c}" for c in BLOCK]).withColumn("group", F.xxhash64("conv_id", *BLOCK))
    spread = joined.repartition("conv_id", *BLOCK).sortWithinPartitions("conv_id", *BLOCK, "turn", "order", "role", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches):
            first = {c: group.column(c)[0].as_py() for c in ("enter", "leave", "cost", "final")}
            roles = [known_role(r) for r in group.column("role").to_pylist()]
            before, leave, cost = first["enter"] or START, first["leave"], first["cost"]
            if leave is None:
                leave, cost = repairer.end(repairer.reached(roles, before)[-1])
            out = []
            for r, s in zip(roles, repairer.path(roles, before, leave), strict=True):
                _, path, merged = repairer.best[r][before, s]
                out.append(Step(ROLES[s], merged, [ROLES[x] for x in path], bool(r) and r != ROLES[s], before == START))
                before = s
            after = [ROLES[x] for x in repairer.finish[before][1]] if first["final"] is not False else None
            yield run(group, out, after, cost)

    return spread.mapInArrow(each, T.StructType([*kind.fields, *T.StructType.fromDDL(ddl).fields]))


@dataclass
class Step:
    """How a message is taken: its role, merged into the turn before, empty turns before it, given another role, first of its conversation."""

    role: str
    merged: bool
    inserted: list[str]
    relabelled: bool
    first: bool


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows of one group in a sorted stream, as Arrow columns; one is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("group").to_numpy()
        edges = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and key[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key[a]
    if held:
        yield pa.Table.from_batches(held)


def whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def repair_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", costs: Costs = Costs(), block: int = 512) -> DataFrame:
    """One row a message: conv_id, k1, k2, k3 (its block), place in it, role (repaired), merged, inserted (roles of the empty turns before it),
    relabelled, first (of its conversation), inserted_after (of the last message, else null), text, cost. Order and blocks: in_blocks."""

    def rows(group: pa.Table, steps: list[Step], after: list[str] | None, cost: int) -> pa.RecordBatch:
        strings = pa.list_(pa.string())
        made = [
            pa.array(np.arange(len(steps))), pa.array([s.role for s in steps]), pa.array([s.merged for s in steps]), pa.array([s.inserted for s in steps], strings), pa.array([s.relabelled for s in steps]),
            pa.array([s.first for s in steps]), pa.array([None] * (len(steps) - 1) + [after], strings), whole(group.column("text")), pa.array([cost] * len(steps), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays([*(whole(group.column(c)) for c in ("conv_id", *BLOCK)), *made], ["conv_id", *BLOCK, "place", "role", "merged", "inserted", "relabelled", "first", "inserted_after", "text", "cost"])

    ddl = "k1 bigint, k2 bigint, k3 bigint, place bigint, role string, merged boolean, inserted array<string>, relabelled boolean, first boolean, inserted_after array<string>, text string, cost bigint"
    return solved(df, conv, turn, role, text, costs, block, rows, ddl)


def escaped(text: str, *marks: str) -> str:
    """The text with a backslash inside each mark, so that no message opens or closes a turn."""
    for mark in marks:
        if mark:
            text = text.replace(mark, mark[0] + "\\" + mark[1:])
    return text


def rendered(texts: list[str], steps: list[Step], after: list[str] | None, opening: str, closing: str) -> str:
    """A block's part of its conversation's text. A turn is closed by the next one, or at the end (after is not None): so a block
    needs to know nothing of the one behind it."""
    out, close = [], f"{closing}\n"
    empty = lambda roles: "".join(f"{opening}{r}\n{close}" for r in roles)
    for t, s in zip(texts, steps, strict=True):
        if s.merged:
            out.append("\n")
        else:
            out += ["" if s.first else close, empty(s.inserted), f"{opening}{s.role}\n"]
        out.append(escaped(t, opening, closing))
    if after is not None:
        out += [close, empty(after)]
    return "".join(out)


def format_chats(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", costs: Costs = Costs(), opening: str = "<|im_start|>", closing: str = "<|im_end|>", block: int = 512
) -> DataFrame:
    """conv_id, part, n_messages, n_turns, n_merged, n_relabelled, n_inserted, cost (of the whole conversation), rendered: one row a block of every
    conversation, of which those of less than block turns have one. The parts' texts in the order of part are the conversation's.

    A null role, or one that is no role, takes any at no cost; null texts are empty; null conv_ids are one conversation, null turns
    come first; repeated rows are messages of their own; messages of one turn go by a hash of role and text; an empty table gives no rows; other columns are
    ignored. Of paths of equal cost that with the lesser states at the borders of blocks, then within each, is taken. Marks inside messages are escaped: a backslash comes behind their first letter. Long texts: a block's are held at once.
    """

    def part(group: pa.Table, steps: list[Step], after: list[str] | None, cost: int) -> pa.RecordBatch:
        inserted = sum(len(s.inserted) for s in steps) + len(after or ())
        opened = sum(not s.merged for s in steps)
        one = lambda x: pa.array([x], pa.int64())
        text = rendered(group.column("text").to_pylist(), steps, after, opening, closing)
        values = [one(len(steps)), one(opened + inserted), one(len(steps) - opened), one(sum(s.relabelled for s in steps)), one(inserted), one(cost), pa.array([text], pa.string())]
        key = pa.StructArray.from_arrays([whole(group.column(c)).slice(0, 1) for c in BLOCK], BLOCK)
        return pa.RecordBatch.from_arrays([whole(group.column("conv_id")).slice(0, 1), key, *values], ["conv_id", "part", "n_messages", "n_turns", "n_merged", "n_relabelled", "n_inserted", "cost", "rendered"])

    ddl = "part struct<k1:bigint,k2:bigint,k3:bigint>, n_messages bigint, n_turns bigint, n_merged bigint, n_relabelled bigint, n_inserted bigint, cost bigint, rendered string"
    return solved(df, conv, turn, role, text, costs, block, part, ddl)
