import random
from itertools import product

from sparkwarden.llm import chat as C


def plain_cost(roles):
    """The least cost over all ways to give every turn a role and either merge it or put it after empty turns."""
    def gap(state, role):
        best = None
        for n in range(4):
            for fill in product(C.ROLES, repeat=n):
                s, ok = state, True
                for x in (*fill, role):
                    ok, s = ok and x in C.LEGAL[s], x
                if ok and best is None:
                    best = n
        return best

    ends = {"start": 0, "assistant": 0, "user": C.INSERT, "system": 2 * C.INSERT}
    costs = {"start": 0}
    for r in roles:
        after = {}
        for (s, x), new in product(costs.items(), C.ROLES):
            change = 0 if r == new else C.RELABEL if r in C.ROLES else C.UNKNOWN
            if s == new:
                after[new] = min(after.get(new, 10**9), x + change + C.MERGE)
            if (n := gap(s, new)) is not None:
                after[new] = min(after.get(new, 10**9), x + change + C.INSERT * n)
        costs = after
    return min(x + ends[s] for s, x in costs.items())


def chat_of(rows):
    return "".join(p for *_, p in rows)


def legal(text):
    """Parses a rendered chat back to its roles and checks the automaton."""
    roles, state = [], "start"
    for part in text.split(C.CLOSE)[:-1]:
        role = part.split("|>\n")[0].removeprefix("<|")
        assert role in C.LEGAL[state], text
        roles.append(role)
        state = role
    assert state in ("start", "assistant")
    return roles


def test_costs_are_least_and_chats_legal():
    r = random.Random(1)
    for _ in range(400):
        roles = [r.choice([*C.ROLES, "tool", None]) for _ in range(r.randint(1, 7))]
        done = C.repaired([(x, f"t{i}") for i, x in enumerate(roles)])
        assert sum(x[3] for x in done) == plain_cost(roles), roles
        legal(chat_of(done))
        assert all(f"t{i}" in done[i][4] for i in range(len(roles)))


def test_rendering():
    done = C.repaired([("system", "be kind"), ("user", "hi"), ("user", "there"), ("assistant", None)])
    assert chat_of(done) == "<|system|>\nbe kind\n<|end|>\n<|user|>\nhi\n\nthere\n<|end|>\n<|assistant|>\n\n<|end|>\n"
    assert [x[0] for x in done] == ["keep", "keep", "merge", "keep"]
    assert chat_of(C.repaired([("user", "a")])) == "<|user|>\na\n<|end|>\n<|assistant|>\n\n<|end|>\n"


def test_rows_equal_brute_force(spark):
    r = random.Random(2)
    rows = [(conv, t, r.choice(["user", "assistant", "USER", "system", "bot", None]), f"x{conv}-{t}") for conv in range(40) for t in range(r.randint(1, 9))]
    rows += [(99, t, r.choice(["user", "assistant"]), f"long {t}") for t in range(700)]  # more than half of all rows
    rows += [(50, None, "user", "no turn"), (50, 1, "assistant", None), (51, 1, "user", "same"), (51, 1, "user", "same"), (None, 0, "user", "no id"),
             (None, 1, "user", "no id"), (52, 0, "user", "y" * 500_000)]
    given = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "0 as part", "'x' as piece", "1 as cost")
    low = lambda x: x.lower() if x else x
    want = []
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in (x[1], low(x[2]), x[3]))
    for conv in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: [(k[0], k[1] if k[0] else "") for k in key(x)])
        want += [(conv, x[1], x[2], a, n, p) for x, (a, n, _, _, p) in zip(own, C.repaired([(low(x[2]), x[3]) for x in own]), strict=True)]
    costs = sum(sum(x[3] for x in C.repaired([(low(x[2]), x[3]) for x in sorted((y for y in rows if y[0] == k), key=lambda x: [(k[0], k[1] if k[0] else "") for k in key(x)])]))
                for k in {x[0] for x in rows})
    one = C.formatted(given, 1).collect()
    assert sorted(((x.conv_id, x.turn, x.role, x.action, x.new_role, x.piece) for x in one), key=str) == sorted(want, key=str)
    many = C.formatted(given, 13).collect()  # the long one lies over several partitions
    assert sum(x.cost for x in many) == sum(x.cost for x in one) == costs
    for conv in {x[0] for x in rows}:
        own = sorted((x for x in many if x.conv_id == conv), key=lambda x: (x.turn is not None, x.turn))
        if len({x.turn for x in own}) == len(own):
            legal("".join(x.piece for x in own))


def test_empty(spark):
    assert C.formatted(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
