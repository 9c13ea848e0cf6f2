"""Chat formatting by minimum-cost role repair.

Legal conversations: perhaps a system turn, then user and assistant in turn, ending with
the assistant. For each turn dynamic programming over this automaton chooses to keep its
role or relabel it, to merge it with the turn before, or to insert empty turns before it;
after the last turn, to insert what the end needs. The cheapest path is rendered. Text is
never dropped.

All turns are sorted by conversation and number over all partitions and numbered in that
order; a conversation is cut into chunks of these numbers. A chunk is a matrix of the least costs
from each state to each; matrices multiply (min, +), so the states at chunk borders are
found without its texts, and chunks are then repaired apart: a conversation with a third
of all turns is many tasks, also where all of them have one number or none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("start", "system", "user", "assistant")
#: Roles by other names.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
#: Turns of a chunk, at most.
CHUNK = 4096
INF = float("inf")


@dataclass(frozen=True)
class Costs:
    """merge: with the turn before; relabel: a known role, demote: system inside a conversation to user;
    unknown: to name a role that isn't known; insert: an empty turn; blank: what a turn without text costs to merge."""

    merge: float = 1.0
    relabel: float = 4.0
    demote: float = 1.5
    unknown: float = 0.5
    insert: float = 2.0
    blank: float = 0.25


#: Turns to insert from a state before a turn of a role can follow; None: it can't.
_GAP = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, SYSTEM): None, (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, SYSTEM): None, (USER, USER): (ASSISTANT,), (USER, ASSISTANT): (),
    (ASSISTANT, SYSTEM): None, (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: Turns to insert at the end.
_END = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def known_role(role: str | None) -> int:
    """State of a role as written; 0 where it isn't known."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES[1:] else 0


def steps(state: int, role: int, blank: bool, costs: Costs):
    """Ways to take a turn from a state: (cost, new state, merged, inserted turns)."""
    for to in (role, *(t for t in (USER, ASSISTANT, SYSTEM) if t != role)) if role else (USER, ASSISTANT, SYSTEM):
        label = 0.0 if to == role else costs.unknown if not role else costs.demote if role == SYSTEM and to == USER else costs.relabel
        if to == state:
            yield label + (costs.blank if blank else costs.merge), to, True, ()
        gap = _GAP[state, to]
        if gap is not None:
            yield label + costs.insert * len(gap), to, False, gap


def end_cost(state: int, costs: Costs) -> float:
    return costs.insert * len(_END[state])


def product(matrix: list[list[float]], role: int, blank: bool, costs: Costs) -> list[list[float]]:
    """A chunk's least costs with one more turn."""
    ways = [list(steps(s, role, blank, costs)) for s in range(4)]
    out = [[INF] * 4 for _ in range(4)]
    for a in range(4):
        for s in range(4):
            if matrix[a][s] < INF:
                for cost, to, _, _ in ways[s]:
                    out[a][to] = min(out[a][to], matrix[a][s] + cost)
    return out


IDENTITY = [[0.0 if a == b else INF for b in range(4)] for a in range(4)]


def borders(matrices: list[list[list[float]]], costs: Costs) -> list[tuple[int, int]]:
    """States in which each chunk of a conversation begins and ends, on the cheapest path."""
    best, back = [0.0, INF, INF, INF], []
    for m in matrices:
        new, prev = [INF] * 4, [0] * 4
        for s in range(4):
            for to in range(4):
                if best[s] + m[s][to] < new[to]:
                    new[to], prev[to] = best[s] + m[s][to], s
        best = new
        back.append(prev)
    state = min(range(4), key=lambda s: (best[s] + end_cost(s, costs), -s))
    out = []
    for prev in reversed(back):
        out.append((prev[state], state))
        state = prev[state]
    return out[::-1]


def repair(turns: list[tuple[int, bool]], first: int = START, last: int | None = None, costs: Costs = Costs()):
    """The cheapest path of turns (role, blank) from state to state: (state, merged, inserted) for each."""
    best = [INF] * 4
    best[first] = 0.0
    back = []
    for role, blank in turns:
        new, prev = [INF] * 4, [None] * 4
        for s in range(4):
            if best[s] < INF:
                for cost, to, merged, gap in steps(s, role, blank, costs):
                    if best[s] + cost < new[to]:
                        new[to], prev[to] = best[s] + cost, (s, merged, gap)
        best = new
        back.append(prev)
    state = last if last is not None else min(range(4), key=lambda s: (best[s] + end_cost(s, costs), -s))
    out = []
    for prev in reversed(back):
        s, merged, gap = prev[state]
        out.append((state, merged, gap))
        state = s
    return out[::-1]


OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def escape(text: str | None) -> str:
    """Text in which no marker of the format can begin."""
    return (text or "").replace("<|", "< |")


def segments(turns: list[tuple[str | None, str | None]], first: int = START, last: int | None = None, closing: bool = True, costs: Costs = Costs()):
    """(turn's index or None, role, action, rendered) of a repaired run of (role, text); joined, ``rendered`` is the chat."""
    roles = [(known_role(r), not (t or "").strip()) for r, t in turns]
    path, state = repair(roles, first, last, costs), first
    for k, (to, merged, gap) in enumerate(path):
        for g in gap:
            yield None, ROLES[g], "insert", (CLOSE if state else "") + OPEN.format(ROLES[g])
            state = g
        action = "keep" if roles[k][0] == to else "relabel"
        text = escape(turns[k][1])
        if merged:
            yield k, ROLES[to], action + "+merge" if action == "relabel" else "merge", "\n\n" + text
        else:
            yield k, ROLES[to], action, (CLOSE if state else "") + OPEN.format(ROLES[to]) + text
        state = to
    if closing:
        for g in _END[state]:
            yield None, ROLES[g], "insert", (CLOSE if state else "") + OPEN.format(ROLES[g])
            state = g
        if state:
            yield None, ROLES[state], "end", CLOSE


def _runs(batches, n_key: int):
    """Rows of consecutive equal keys (the first n_key columns) of sorted batches, one after another."""
    key = None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            new = row[:n_key] != key
            key = row[:n_key]
            yield new, row


def format_chats(conversations: DataFrame, costs: Costs = Costs(), chunk: int = CHUNK) -> DataFrame:
    """conv_id, chunk, n, turn, role, action, rendered: the repaired conversations, a row for each piece.

    Pieces in order of chunk and n, ``rendered`` joined, are a conversation's text.
    Turns go by number, nulls first; equal numbers by role and text. Rows whose conv_id
    is null are conversations of one turn. Null and empty texts stay as empty turns, long
    texts stay whole; unknown and null roles are named at a cost. Repeated rows are turns
    of their own. Other columns are ignored; an empty table gives no rows."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1)).alias("own"),
        F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    ).withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))  # equal rows are apart as well
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "own", "turn", "role", "text", "tie")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("at", F.monotonically_increasing_id())
    rows = materialise(placed.withColumn("chunk", F.floor(F.col("at") / chunk).cast("long")), "turns")
    key = ["conv_id", "own", "chunk"]
    order = [*key, "at"]
    plain = rows.select(*key, "at", "role", (F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")) == "").alias("blank"))

    def matrices(batches):
        import pyarrow as pa

        keys, out, m = [], [], None
        for new, row in _runs(batches, 3):
            if new:
                if m is not None:
                    out.append([c for r in m for c in r])
                keys.append(row[:3])
                m = IDENTITY
            m = product(m, known_role(row[3]), row[4], costs)
        if m is not None:
            out.append([c for r in m for c in r])
        cols = list(zip(*keys)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.int64()) for c in cols), pa.array(out, pa.list_(pa.float64()))], names=["conv_id", "own", "chunk", "m"])

    by_turn = plain.repartition(*key).sortWithinPartitions(*order).select(*key, "role", "blank")
    chunks = materialise(by_turn.mapInArrow(matrices, "conv_id long, own long, chunk long, m array<double>"), "chunks")

    def ends(batches):
        import pyarrow as pa

        got, out = [], []

        def close():
            if got:
                ms = [[r[3][4 * a : 4 * a + 4] for a in range(4)] for r in got]
                out.extend((*r[:3], a, b, k == len(got) - 1, k) for k, (r, (a, b)) in enumerate(zip(got, borders(ms, costs))))
                got.clear()

        for new, row in _runs(batches, 2):
            if new:
                close()
            got.append(row)
        close()
        cols = list(zip(*out)) or [()] * 7
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["conv_id", "own", "chunk", "first", "last", "closing", "part"])

    by_chunk = chunks.repartition("conv_id", "own").sortWithinPartitions(*key)
    plan = materialise(by_chunk.mapInArrow(ends, "conv_id long, own long, chunk long, first int, last int, closing boolean, part long"), "borders")
    plan = plan.select(*[F.col(c).alias(f"_{c}") for c in key], "first", "last", "closing", "part")
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("own") == F.col("_own")) & (F.col("chunk") == F.col("_chunk"))
    told = rows.join(plan, same).select(*key, "first", "last", "closing", "part", "turn", "role", "text", "at")

    def rendered(batches):
        import pyarrow as pa

        got: list = []

        def close():
            if not got:
                return None
            conv, _, _, first, last, closing, part = got[0][:7]
            out = [(conv, part, n, None if k is None else got[k][7], role, action, text) for n, (k, role, action, text) in enumerate(segments([(r[8], r[9]) for r in got], first, last, closing, costs))]
            got.clear()
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=["conv_id", "chunk", "n", "turn", "role", "action", "rendered"])

        for new, row in _runs(batches, 3):
            if new and (b := close()) is not None:
                yield b
            got.append(row)
        if (b := close()) is not None:
            yield b

    ordered = told.repartition(*key).sortWithinPartitions(*order)
    return ordered.mapInArrow(rendered, "conv_id long, chunk long, n long, turn long, role string, action string, rendered string")


def op6_role_repair(spark, sf_dir):
    return format_chats(table(spark, sf_dir, "conversations"))


QUERIES = {"op6_role_repair": op6_role_repair}
