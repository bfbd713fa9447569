"""Chat formatting with the cheapest repair of roles.

A legal conversation is an optional system turn, then user and assistant turns in alternation, the last one by the assistant. Dynamic programming over this
automaton chooses, turn by turn, to keep the role, to relabel it, to merge the turn with the one before, or to insert an empty turn, so that the
sum of the costs is least. Turns are then rendered with role markers.

Turns are sorted by conversation over range partitions, and a conversation may extend over many: of the pieces at a partition's ends, each task reports the cheapest way from
each state to each state, a few numbers per partition. They are put together, and each piece is then repaired between the states it must join.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylark.llm.common import checkpointed, small_batches

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
#: States that may follow a state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
NEVER = float("inf")
#: Turns of a sequence of roles whose repair a worker remembers, and sequences that it remembers; then it starts afresh.
REMEMBERED_TURNS, REMEMBERED = 64, 20_000
SCHEMA = "place bigint, conv_id {}, turn {}, role string, text string, new_role string, op string, opens int, cost double, rendered string"


@dataclass(frozen=True)
class Costs:
    merge: float = 1.0
    insert: float = 2.0
    relabel: float = 3.0
    #: Of a role that is null or not known.
    name: float = 0.5


def steps(role: str | None, costs: Costs) -> list[tuple[int, int, float, str, tuple[int, ...]]]:
    """What a turn can become: (state before, state after, cost, operation, inserted roles), the preferred of equals first."""
    given, out = ROLES.get((role or "").strip().lower()), []
    for label in (SYSTEM, USER, ASSISTANT):
        base, how = (0.0, "keep") if label == given else (costs.name if given is None else costs.relabel, "relabel")
        for before in NEXT:
            if label in NEXT[before]:
                out.append((before, label, base, how, ()))
                continue
            if label == before:
                out.append((before, label, base + costs.merge, "merge" if how == "keep" else "relabel+merge", ()))
            for middle in NEXT[before]:
                if label in NEXT[middle]:
                    out.append((before, label, base + costs.insert, "insert" if how == "keep" else "relabel+insert", (middle,)))
    return sorted(out, key=lambda s: s[2])


def end_cost(state: int, costs: Costs) -> float:
    """Cost of ending in a state: after a user's or a system's turn empty turns are inserted."""
    return {START: 0.0, ASSISTANT: 0.0, USER: costs.insert, SYSTEM: 2 * costs.insert}[state]


def cheapest(roles: list, start: int, costs: Costs, table: dict) -> tuple[list[float], list[list]]:
    """Least cost to reach each state from the start, and for every turn the step by which each state is reached."""
    now, back = [0.0 if s == start else NEVER for s in range(4)], []
    for role in roles:
        then, how = [NEVER] * 4, [None] * 4
        for step in table.setdefault(role, steps(role, costs)):
            cost = now[step[0]] + step[2]
            if cost < then[step[1]]:
                then[step[1]], how[step[1]] = cost, step
        now = then
        back.append(how)
    return now, back


def path(back: list[list], end: int) -> list:
    out = []
    for how in reversed(back):
        out.append(how[end])
        end = out[-1][0]
    return out[::-1]


def mark(role: int) -> str:
    return f"<|im_start|>{NAMES[role]}\n"


CLOSE = "<|im_end|>\n"


def fragments(texts: list, chosen: list, state: int, last: bool) -> list[str]:
    """What each turn adds to the rendered conversation; put together in order they are the whole."""
    out = []
    for text, (before, after, _, _, inserted) in zip(texts, chosen, strict=True):
        made = ""
        if not inserted and before == after:
            made = "\n" + (text or "")
        else:
            made = CLOSE * (before != START) + "".join(mark(r) + CLOSE for r in inserted) + mark(after) + (text or "")
        out.append(made)
        state = after
    if last and out:
        out[-1] += CLOSE + (mark(USER) + CLOSE) * (state == SYSTEM) + (mark(ASSISTANT) + CLOSE) * (state in (SYSTEM, USER))
    return out


@dataclass
class Repair:
    """One task's work on sorted turns. fixed: for (partition, conversation) pieces of conversations over several partitions, the states before and after, and whether it is the last.

    Ids and turn numbers stay Arrow arrays and are never numbers of Python's or of another type on their way.
    """

    costs: Costs
    fixed: dict | None = None
    table: dict = field(default_factory=dict)
    known: dict = field(default_factory=dict)

    def pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, list, list]]:
        """(partition, conversation, roles, texts) of each run of turns of one conversation."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, roles, texts = (batch.column(c).to_pylist() if c in batch.schema.names else None for c in ("conv_id", "role", "text"))
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if held and held[1] != keys[a]:
                    yield held
                    held = None
                if held is None:
                    held = (batch.column("part")[0].as_py(), keys[a], [], [])
                held[2].extend(roles[a:b])
                if texts:
                    held[3].extend(texts[a:b])
        if held:
            yield held

    def ends(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Costs from each state to each state for the first and the last piece of the partition."""
        first = last = None
        kind = pa.null()

        def typed():
            nonlocal kind
            for batch in batches:
                kind = batch.column("conv_id").type
                yield batch

        for number, (part, conv, roles, _) in enumerate(self.pieces(typed())):
            last = (part, number, conv, roles)
            first = first or last
        rows = [] if first is None else [first] if first is last else [first, last]
        if rows:
            costs = [[c for s in range(4) for c in cheapest(roles, s, self.costs, self.table)[0]] for *_, roles in rows]
            columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], kind), pa.array(costs, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "number", "conv_id", "costs"])

    def chosen(self, roles: list, start: int, end: int | None) -> list:
        """The cheapest steps; those of short sequences of roles are remembered."""
        key = (*roles, start, end) if len(roles) <= REMEMBERED_TURNS else None
        found = self.known.get(key)
        if found is None:
            now, back = cheapest(roles, start, self.costs, self.table)
            if end is None:
                end = min(range(4), key=lambda s: now[s] + end_cost(s, self.costs))
            found = path(back, end)
            if key:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[key] = found
        return found

    def repaired(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()
        done: list[list] = [[], [], [], [], []]

        def noted():
            for batch in batches:
                if batch.num_rows:
                    waiting.append(batch)
                    yield batch

        for part, conv, roles, texts in self.pieces(noted()):
            start, end, last = self.fixed.get((part, conv), (START, None, True))
            steps_of = self.chosen(roles, start, end)
            done[0] += [NAMES[s[1]] for s in steps_of]
            done[1] += [s[3] for s in steps_of]
            done[2] += [0 if s[0] == s[1] and not s[4] else 1 + len(s[4]) for s in steps_of]
            done[3] += [s[2] for s in steps_of]
            if last:
                done[3][-1] += end_cost(steps_of[-1][1], self.costs)
            done[4] += fragments(texts, steps_of, start, last)
            while waiting and len(done[0]) >= waiting[0].num_rows:
                yield self.joined(waiting.popleft(), done)
        while waiting and len(done[0]) >= waiting[0].num_rows:
            yield self.joined(waiting.popleft(), done)

    @staticmethod
    def joined(batch: pa.RecordBatch, done: list[list]) -> pa.RecordBatch:
        n, given = batch.num_rows, ("place", "conv_id", "turn", "role", "text")
        columns = [pa.array(column[:n], kind) for column, kind in zip(done, (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.string()), strict=True)]
        for column in done:
            del column[:n]
        return pa.RecordBatch.from_arrays([batch.column(c) for c in given] + columns, [*given, "new_role", "op", "opens", "cost", "rendered"])


def joined(rows: list, costs: Costs) -> dict:
    """The states before and after each piece of conversations that lie in several partitions; rows: what `ends` reports."""
    pieces = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["part"], r["number"])):
        pieces[r["conv_id"]].append(r)
    fixed = {}
    for conv, parts in pieces.items():
        if len(parts) < 2:
            continue
        now, before = [0.0 if s == START else NEVER for s in range(4)], []
        for r in parts:
            ways = [[now[s] + r["costs"][4 * s + t] for s in range(4)] for t in range(4)]
            before.append([w.index(min(w)) for w in ways])
            now = [min(w) for w in ways]
        end = min(range(4), key=lambda s: now[s] + end_cost(s, costs))
        for k in range(len(parts) - 1, -1, -1):
            start = before[k][end]
            fixed[parts[k]["part"], conv] = (start, end, k == len(parts) - 1)
            end = start
    return fixed


def repair_roles(turns: DataFrame, costs: Costs = Costs(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", partitions: int | None = None) -> DataFrame:
    """One row for every turn, with place (grows along each conversation), new_role, op (keep, relabel, merge, insert, or relabel with one of these), opens (turns that begin here, inserted ones included),
    cost (of this turn's repair; the last one's includes that of the end) and rendered (its part of the formatted conversation).

    Turns follow each other by turn number, null first, ties by role and text. Ids and turn numbers keep their types. A null conversation id is a conversation of its own. A null or unknown role
    is named at a low cost; a null text is empty. Repeated rows are turns. Of equally cheap repairs a fixed order of operations decides. Other columns are left out; an empty table gives an empty one.
    A conversation's turns within one partition are held together; one that is longer than a partition is cut by the range of its turns.
    """
    small_batches(turns.sparkSession, 5000)
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    spread = rows.repartitionByRange(*order) if partitions is None else rows.repartitionByRange(partitions, *order)
    held = checkpointed(spread.sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    ends = held.select("part", "conv_id", "role").mapInArrow(Repair(costs).ends, f"part int, number int, conv_id {kinds[0]}, costs array<double>")
    return held.mapInArrow(Repair(costs, joined([r.asDict() for r in ends.collect()], costs)).repaired, SCHEMA.format(*kinds))


def render(repaired: DataFrame) -> DataFrame:
    """(conv_id, text): each conversation as one string, for conversations that fit into one."""
    parts = F.array_sort(F.collect_list(F.struct("place", "rendered")))
    return repaired.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["rendered"]), "").alias("text"))
