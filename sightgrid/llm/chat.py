"""Chat formatting: minimum-cost repair of roles, then rendering.

A legal conversation is a path of an automaton: at most one system turn first, then user and assistant in turn, beginning with
the user and ending with the assistant. Each given turn is kept, relabelled or merged into the turn before it, and empty turns
may be inserted; costs are parameters. Every turn is a (min, +) matrix over the automaton's four states that depends on its
role alone, so repair is dynamic programming, and a stretch of a conversation is a product of matrices. That is how a
conversation of any length is repaired side by side: rows are dealt by range of (conversation, turn, role, hash of the text),
each task gives the matrices of the at most two conversations that reach over its borders, these few are chained to find the
state at each border, and each task then repairs its stretches between known states. No conversation is gathered.

The rendering is given as one fragment for each turn; in the order of ``place`` the fragments of a conversation make its text.

Defined results: roles are compared in lower case without outer white space, with the usual aliases; a null or unknown role
must be relabelled; a null text is empty; turns with one number stand in the order of role and hash; null turn numbers come
first; a null conversation id is one conversation; an empty table gives no row. Ties go to keeping, merging, relabelling and
inserting in this order, then to the earlier role. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightgrid.llm.common import ready
from sightgrid.session import cut_lineage

ROLES = ("system", "user", "assistant")
START, STATES = 3, 4  # a state is the role of the turn before, or START
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant",
           "chatbot": "assistant", "developer": "system"}
INFINITE = 1 << 40


@dataclass(frozen=True)
class Costs:
    merge: int = 2
    relabel: int = 3
    insert: int = 4
    unknown: int = 1  # giving a role to a turn that has none
    end: int = 2  # the state a conversation must end in


def role_of(role: str | None) -> int:
    """0 to 2 for a known role, 3 for any other."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else 3


def _inserts() -> dict[tuple[int, int], tuple[int, ...]]:
    """(state, state) -> the fewest empty turns that lead from one to the other."""
    out = {(s, s): () for s in range(STATES)}
    for _ in range(STATES):
        for (a, b), way in list(out.items()):
            for c in NEXT[b]:
                if (a, c) not in out or len(way) + 1 < len(out[a, c]):
                    out[a, c] = (*way, c)
    return out


INSERTS = _inserts()


def steps(costs: Costs) -> list[list[list[tuple]]]:
    """role -> state -> state: (cost, action, empty turns inserted before) of the cheapest way to take a turn."""
    table = []
    for role in range(4):
        rows = [[(INFINITE, "", ())] * STATES for _ in range(STATES)]
        for a in range(STATES):
            for b in range(3):
                label = 0 if role == b else costs.unknown if role == 3 else costs.relabel
                ways = []
                if a == b:
                    ways.append((costs.merge + label, "merge", ()))
                for c in range(STATES):
                    if (a, c) in INSERTS and b in NEXT[c]:
                        ways.append((label + costs.insert * len(INSERTS[a, c]), "keep" if role == b else "relabel", INSERTS[a, c]))
                if ways:
                    rows[a][b] = min(ways, key=lambda w: (w[0], ("keep", "merge", "relabel").index(w[1]), len(w[2])))
        table.append(rows)
    return table


def _product(matrix: np.ndarray, step: np.ndarray) -> np.ndarray:
    return np.minimum(INFINITE, (matrix[:, :, None] + step[None, :, :]).min(axis=1))


def _ending(costs: Costs) -> np.ndarray:
    return np.array([costs.insert * len(INSERTS[s, costs.end]) if (s, costs.end) in INSERTS else INFINITE for s in range(STATES)])


def _stretches(batches):
    """(conversation, its rows in this partition, whether it is the first and the last here), without holding more than one."""
    now, rows, first = None, [], True
    for batch in batches:
        for row in batch.to_pylist():
            key = ("c", row["conv_id"])
            if key != now and rows:
                yield now[1], rows, first, False
                rows, first = [], False
            now = key
            rows.append(row)
    if rows:
        yield now[1], rows, first, True


def _border_matrices(costs: Costs):
    def run(batches):
        cost = np.array([[[w[0] for w in row] for row in rows] for rows in steps(costs)])
        part, out = TaskContext.get().partitionId(), []
        for conv, rows, first, last in _stretches(batches):
            if first or last:
                matrix = np.where(np.eye(STATES, dtype=bool), 0, INFINITE)
                for row in rows:
                    matrix = _product(matrix, cost[role_of(row["role"])])
                out.append({"part": part, "conv_id": conv, "first": first, "last": last, "costs": matrix.ravel().tolist()})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
            ("part", pa.int32()), ("conv_id", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("costs", pa.list_(pa.int64()))]))

    return run


def _border_states(rows, costs: Costs) -> dict[tuple[int, bool], tuple[int, int | None]]:
    """(partition, whether its first stretch) -> state before and after; None after: the conversation ends there."""
    chains, out = [], {}
    for r in sorted(rows, key=lambda r: (r["part"], not r["first"])):
        if chains and chains[-1][-1]["last"] and r["first"] and chains[-1][-1]["conv_id"] == r["conv_id"]:
            chains[-1].append(r)
        else:
            chains.append([r])
    for chain in chains:
        before = [np.where(np.arange(STATES) == START, 0, INFINITE)]
        matrices = [np.array(r["costs"]).reshape(STATES, STATES) for r in chain]
        for m in matrices:
            before.append(np.minimum(INFINITE, (before[-1][:, None] + m).min(axis=0)))
        state = int(np.argmin(before[-1] + _ending(costs)))
        after: int | None = None
        for k in range(len(chain) - 1, -1, -1):
            start = int(np.argmin(before[k] + matrices[k][:, state])) if k else START
            out[chain[k]["part"], chain[k]["first"]] = (start, after)
            state = after = start
    return out


def _repair(roles: list[int], start: int, after: int | None, table, costs: Costs) -> list[tuple]:
    """(role, action, empty turns before) of each turn of a stretch."""
    vector = [0 if s == start else INFINITE for s in range(STATES)]
    back = []
    for role in roles:
        ways = [min((vector[a] + table[role][a][b][0], a) for a in range(STATES)) for b in range(STATES)]
        back.append([a for _, a in ways])
        vector = [min(INFINITE, c) for c, _ in ways]
    if after is None:
        ending = _ending(costs)
        after = min(range(STATES), key=lambda s: (vector[s] + int(ending[s]), s))
    state, out = after, []
    for k in range(len(roles) - 1, -1, -1):
        before = back[k][state]
        _, action, inserted = table[roles[k]][before][state]
        out.append((state, action, inserted))
        state = before
    return out[::-1]


_COLUMNS = ("conv_id long, place long, turn long, given_role string, role string, action string, inserted int, cost long, "
            "fragment string")


def _renderer(states: dict, costs: Costs, open_turn: str, close_turn: str):
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("given_role", pa.string()),
                        ("role", pa.string()), ("action", pa.string()), ("inserted", pa.int32()), ("cost", pa.int64()),
                        ("fragment", pa.string())])

    def run(batches):
        part, n, out, size = TaskContext.get().partitionId(), 0, [], 0
        table = steps(costs)
        empty = lambda r: open_turn.format(role=ROLES[r])
        for conv, rows, first, last in _stretches(batches):
            start, after = states.get((part, first), (START, None)) if first or last else (START, None)
            roles = [role_of(r["role"]) for r in rows]
            state = start
            for k, (row, (role, action, inserted)) in enumerate(zip(rows, _repair(roles, start, after, table, costs))):
                cost = table[roles[k]][state][role][0]
                piece = []
                if action == "merge":
                    piece.append("\n")
                else:
                    opened = state != START
                    for r in (*inserted, role):
                        piece.append((close_turn if opened else "") + empty(r))
                        opened = True
                piece.append(row["text"] or "")
                state, added = role, len(inserted)
                if k == len(rows) - 1 and after is None:
                    tail = INSERTS[state, costs.end]
                    piece += [close_turn + empty(r) for r in tail] + [close_turn]
                    cost, added = cost + costs.insert * len(tail), added + len(tail)
                out.append((conv, (part << 32) + n, row["turn"], row["role"], ROLES[role], action, added, cost, "".join(piece)))
                n, size = n + 1, size + len(out[-1][-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def formatted(turns: DataFrame, costs: Costs = Costs(), open_turn: str = "<|im_start|>{role}\n",
              close_turn: str = "<|im_end|>\n") -> DataFrame:
    """One row per given turn (conv_id, turn, role, text): its repaired role, what was done, and its fragment of the rendering."""
    keys = ["conv_id", "turn", "role", "h"]
    rows = ready(turns).select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("h"))
    # the partitions are read twice and must be the same ones: a checkpoint keeps them
    rows = cut_lineage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("h"))
    small = rows.select("conv_id", "role").mapInArrow(
        _border_matrices(costs), "part int, conv_id long, first boolean, last boolean, costs array<long>")
    states = _border_states(small.collect(), costs)  # two rows of each partition at most
    return rows.mapInArrow(_renderer(states, costs, open_turn, close_turn), _COLUMNS)
