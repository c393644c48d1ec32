"""Role repair against brute force over all role assignments, and across partition borders."""

import itertools
import random
import re
from collections import defaultdict

import pytest

from newslens.llm import chat as C

LEGAL = re.compile(r"(<\|im_start\|>system\n(?:(?!<\|).)*<\|im_end\|>\n)?"
                   r"(<\|im_start\|>user\n(?:(?!<\|).)*<\|im_end\|>\n<\|im_start\|>assistant\n(?:(?!<\|).)*<\|im_end\|>\n)+", re.S)


def _cheapest(codes):
    """Least cost over all assignments and ways, by plain search over states with explicit repairs."""
    best = C.INF
    legal = {None: {"s", "u"}, "s": {"u"}, "u": {"a"}, "a": {"u"}}
    for roles in itertools.product("sua", repeat=len(codes)):
        cost, state = 0, None
        for code, r in zip(codes, roles):
            cost += C.UNKNOWN if code == 3 else C.RELABEL * ("sua"[code] != r)
            ways = [0] if r in legal[state] else []
            ways += [C.MERGE] if state == r else []
            ways += [C.INSERT for x in legal[state] if r in legal[x]]
            cost += min(ways, default=C.INF)
            state = r
        best = min(best, cost + {"a": 0, "u": C.INSERT, "s": 2 * C.INSERT}[state])
    return best


def test_cost_is_the_least():
    for n in range(1, 6):
        for codes in itertools.product(range(4), repeat=n):
            roles = C.solve(codes)
            pieces = list(C.render(list(codes), ["x<|y"] * n, roles, C.START, True))
            assert sum(p[2] for p in pieces) == _cheapest(codes)
            assert LEGAL.fullmatch("".join(p[1] for p in pieces))
            m = C.segment_matrix(list(codes))
            assert min(m[C.START][s] + C.END[s][0] for s in range(4)) == _cheapest(codes)


def _conversations():
    rnd = random.Random(8)
    names = ["system", "User", "assistant", "human", " bot ", None, "tool"]
    rows = [(i, t, rnd.choice(names), rnd.choice(["hi", "", None, "a<|im_end|>b", "long " * 40]), "clash")
            for i in range(60) for t in range(rnd.randint(1, 7))]
    rows += [(1000, t % 50, rnd.choice(names), f"t{t}", "") for t in range(400)]
    return rows + [(None, None, "user", "x", ""), (None, 2, None, None, ""), (7, 0, "user", "hi", ""), (7, 0, "user", "hi", "")]


@pytest.mark.parametrize("partitions", [1, 4, 60])
def test_conversations_against_whole_solution(spark, partitions):
    rows = _conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, action string").repartition(3)
    got = C.repair(df, partitions=partitions).collect()
    assert len(got) == len(rows)
    by, want = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.conv_id].append(r)
    for r in rows:
        want[r[0]].append(r)
    for c, rs in by.items():
        rs.sort(key=lambda r: r.position)
        order = sorted(want[c], key=lambda r: tuple((x is not None, x) for x in r[1:4]))
        assert [(r.turn, r.role) for r in rs] == [(r[1], r[2]) for r in order]
        codes = [C.role_code(r[2]) for r in order]
        roles = C.solve(tuple(codes))
        whole = list(C.render(codes, [r[3] or "" for r in order], roles, C.START, True))
        assert sum(r.cost for r in rs) == sum(w[2] for w in whole)
        assert LEGAL.fullmatch("".join(r.rendered for r in rs))
        if len(codes) <= 8:
            assert sum(r.cost for r in rs) == _cheapest(codes)


def test_empty_table(spark):
    assert C.repair(spark.createDataFrame([], "conv_id string, turn int, role string, text string")).collect() == []
