"""Chat formatting with minimum-cost role repair.

The legal conversations are an automaton: an optional system turn, then user and assistant turns in turns, the last one the
assistant's. Dynamic programming over its states picks, for every turn, the cheapest of keeping or changing its role,
merging it with the turn before and inserting empty turns, and the repaired turns are rendered.

A conversation may be longer than a task should hold, so conversations are dealt out by ranges of (conversation, turn),
and one that crosses a border is solved in segments. A segment's effect is a small matrix: the least cost from every
state it may be entered in to every state it may be left in. The (at most two) border segments of each partition send
theirs to the driver, which chains them and tells every segment the states to enter and leave in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens.llm.common import bound_batches, cut_lineage
from newslens.sources.tables import table

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "bot": "assistant", "ai": "assistant", "model": "assistant", "gpt": "assistant"}
#: Costs of a merge, of changing a known and an unknown role, and of inserting an empty turn.
MERGE, RELABEL, UNKNOWN, INSERT = 1, 2, 1, 3
START = 3
#: Roles that may follow each state at no cost; anything else needs a merge or inserted turns.
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
OPEN, CLOSE, JOIN = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"
INF = math.inf


def _step(state: int, role: int) -> tuple[float, tuple[int, ...], bool]:
    """(cost, inserted roles, merged) of the cheapest way from ``state`` to a turn of ``role``."""
    ways = [(0, (), False)] if role in NEXT[state] else []
    if state == role:
        ways.append((MERGE, (), True))
    ways += [(INSERT, (mid,), False) for mid in NEXT[state] if role in NEXT[mid]]
    return min(ways, key=lambda w: (w[0], not w[2])) if ways else (INF, (), False)


STEP = [[_step(s, r) for r in range(3)] for s in range(4)]
#: (cost, inserted roles) to end in a state; nothing has begun in START.
END = {START: (0, ()), 0: (2 * INSERT, (1, 2)), 1: (INSERT, (2,)), 2: (0, ())}


def role_code(role: str | None) -> int:
    """0, 1, 2 for a known role whatever its case and outer white space, 3 for any other or none."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else 3


def _relabel(code: int, role: int) -> int:
    return UNKNOWN if code == 3 else RELABEL * (code != role)


def segment_matrix(codes: list[int]) -> list[list[float]]:
    """Least cost of the turns from every entry state (row) to every exit state (column)."""
    out = []
    for entry in range(4):
        v = [INF] * 4
        v[entry] = 0
        for code in codes:
            v = [min(v[s] + STEP[s][r][0] for s in range(4)) + _relabel(code, r) for r in range(3)] + [INF]
        out.append(v)
    return out


def solve(codes: tuple[int, ...], entry: int = START, leave: int | None = None) -> list[int]:
    """The roles of the turns on the cheapest way from ``entry`` to ``leave``, or to any state and the end; among
    equal ways the one whose last differing role comes first in ROLES."""
    v, back = [INF] * 4, []
    v[entry] = 0
    for code in codes:
        new, came = [INF] * 4, [0] * 4
        for r in range(3):
            s = min(range(4), key=lambda s: v[s] + STEP[s][r][0])
            new[r], came[r] = v[s] + STEP[s][r][0] + _relabel(code, r), s
        v = new
        back.append(came)
    state = min(range(3), key=lambda s: v[s] + END[s][0]) if leave is None else leave
    out = []
    for came in reversed(back):
        out.append(state)
        state = came[state]
    return out[::-1]


@lru_cache(maxsize=1 << 14)
def _solve_short(codes: tuple[int, ...], entry: int, leave: int | None) -> list[int]:
    return solve(codes, entry, leave)


def _turn(role: int, text: str = "") -> str:
    return OPEN.format(ROLES[role]) + text


def render(codes: list[int], texts: list[str], roles: list[int], entry: int, last: bool) -> Iterator[tuple[str, str, float]]:
    """(action, rendered, cost) of every turn. A turn's piece closes the one before unless it joins it, so that the
    pieces in order are the conversation; the last also closes itself and adds what the end needs. Template
    marks inside a text are broken up."""
    state = entry
    for i, (code, text, role) in enumerate(zip(codes, texts, roles)):
        cost, inserted, merged = STEP[state][role]
        done = [f"insert {ROLES[x]}" for x in inserted] + ["merge"] * merged + ["relabel"] * (code != role)
        piece = CLOSE * (state != START and not merged) + "".join(_turn(x) + CLOSE for x in inserted)
        piece += (JOIN if merged else _turn(role)) + text.replace("<|", "< |")
        cost += _relabel(code, role)
        if last and i == len(codes) - 1:
            extra, tail = END[role]
            piece += CLOSE + "".join(_turn(x) + CLOSE for x in tail)
            cost += extra
            done += [f"append {ROLES[x]}" for x in tail]
        yield ",".join(done) or "keep", piece, float(cost)
        state = role


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator]]:
    """(conversation, its rows) in the partition's order."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
    return groupby(rows, key=lambda r: r[0])


def _chain(borders: list) -> dict[int, list[tuple[int, int | None, bool]]]:
    """(entry, exit, last) for the first and the last segment of every partition. ``borders``: (partition, segments,
    first id, last id, first matrix, last matrix) in order of partitions."""
    links: list[list] = []  # [partition, which (0 first, 1 last), id, matrix], by chain
    for part, n, first, final, m, w in borders:
        if links and links[-1][-1][2] == first:
            links[-1].append([part, 0, first, m])
        else:
            links.append([[part, 0, first, m]])
        if n > 1:
            links.append([[part, 1, final, w]])
    out: dict[int, list] = {}
    for chain in links:
        v, back = [INF, INF, INF, 0], []
        for *_, m in chain:
            came = [min(range(4), key=lambda s: v[s] + m[4 * s + t]) for t in range(4)]
            v = [v[came[t]] + m[4 * came[t] + t] for t in range(4)]
            back.append(came)
        state = min(range(4), key=lambda s: v[s] + END[s][0])
        for i in range(len(chain) - 1, -1, -1):
            entry = back[i][state]
            out.setdefault(chain[i][0], [None, None])[chain[i][1]] = (entry, state, i == len(chain) - 1)
            state = entry
    return out


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           partitions: int | None = None) -> DataFrame:
    """A row per row of ``turns``: conv, turn, position, role, new_role, action, cost, rendered.

    ``rendered`` in order of ``position`` within a conversation is the repaired conversation; the costs add up to the
    least possible. Turns are in the order of ``turn`` (NULL first), then role and text, so repeated rows are turns
    like any other. Rows without a conversation id are one conversation. A NULL text is an empty turn; a NULL or
    unknown role may become any. No rows: no rows. Further columns are not read.
    """
    spark = turns.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["c", "o", "r", "t"]
    rows = bound_batches(turns).select(F.col(conv).alias("c"), F.col(turn).alias("o"), F.col(role).alias("r"),
                                       F.col(text).alias("t"))
    rows = cut_lineage(rows.repartitionByRange(n, "c", "o", "r", F.xxhash64("t")).sortWithinPartitions(*by))
    key = turns.schema[conv].dataType
    matrix = "array<double>"

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = final = None
        count = 0
        for c, seg in _segments(batches):
            final = (c, [role_code(r[2]) for r in seg])
            first = first or final
            count += 1
        if count:
            ids = [[first[0]], [final[0]]]
            ms = [[x for row in segment_matrix(codes) for x in row] for codes in (first[1], final[1])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([count], pa.int64()), *[pa.array(i, kind) for i in ids],
                 *[pa.array([m], pa.list_(pa.float64())) for m in ms]], names=["part", "n", "first", "final", "m", "w"])

    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

    kind = to_arrow_type(key)
    borders = rows.select("c", "o", "r").mapInArrow(edges, f"part int, n long, first {key.simpleString()}, "
                                                           f"final {key.simpleString()}, m {matrix}, w {matrix}")
    plan = _chain(sorted((tuple(r) for r in borders.collect()), key=lambda r: r[0]))  # at most a row per partition
    schema = T.StructType([T.StructField(conv, key), T.StructField(turn, turns.schema[turn].dataType),
                           T.StructField("position", T.LongType()), T.StructField("role", T.StringType()),
                           T.StructField("new_role", T.StringType()), T.StructField("action", T.StringType()),
                           T.StructField("cost", T.DoubleType()), T.StructField("rendered", T.StringType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, at, out = to_arrow_schema(schema), TaskContext.get().partitionId(), 0, []

        def flush():
            cols = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, own)], schema=own)

        todo = _segments(batches)
        now = next(todo, None)
        held = now and (now[0], list(now[1]))
        which = 0
        while held:
            c, seg = held
            now = next(todo, None)
            held = now and (now[0], list(now[1]))
            edge = plan[part][0] if which == 0 else plan[part][1] if held is None else None
            entry, leave, last = edge or (START, None, True)
            codes = [role_code(r[2]) for r in seg]
            roles = (_solve_short if len(codes) <= 16 else solve)(tuple(codes), entry, leave)
            for r, new, piece in zip(seg, roles, render(codes, [r[3] or "" for r in seg], roles, entry, last)):
                out.append((c, r[1], (part << 40) + at, r[2], ROLES[new], piece[0], piece[2], piece[1]))
                at += 1
            which += 1
            if len(out) >= 512:
                yield flush()
                out.clear()
        if out:
            yield flush()

    return rows.mapInArrow(write, schema)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
