import itertools
import random

from sightgrid.llm import chat

LEGAL = chat.NEXT


def brute_cost(roles, costs=chat.Costs(), limit=3):
    """Cheapest repair by trying every final role, merge and number of empty turns before each turn (short inputs)."""
    best = None

    def ways(state, k, spent):
        nonlocal best
        if best is not None and spent >= best:
            return
        if k == len(roles):
            for n in range(limit):
                for tail in itertools.product(range(3), repeat=n):
                    s, ok = state, True
                    for r in tail:
                        ok, s = ok and r in LEGAL[s], r
                    if ok and s == costs.end and (best is None or spent + n * costs.insert < best):
                        best = spent + n * costs.insert
            return
        label = lambda r: 0 if r == roles[k] else costs.unknown if roles[k] == 3 else costs.relabel
        if state != chat.START:
            ways(state, k + 1, spent + costs.merge + label(state))
        for n in range(limit):
            for before in itertools.product(range(3), repeat=n):
                s, ok = state, True
                for r in before:
                    ok, s = ok and r in LEGAL[s], r
                if ok:
                    for r in LEGAL[s]:
                        ways(r, k + 1, spent + n * costs.insert + label(r))

    ways(chat.START, 0, 0)
    return best


def rows_of(spark, conversations, parts=None):
    names = [*chat.ROLES, "narrator"]
    rows = [(c, t, names[r], f"text {c} {t}") for c, roles in conversations.items() for t, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.repartition(parts) if parts else df


def check_legal(text):
    turns = [t.split("\n", 1)[0] for t in text.split("<|im_start|>")[1:]]
    if turns[0] == "system":
        turns = turns[1:]
    assert turns and len(turns) % 2 == 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(turns))
    assert text.count("<|im_end|>\n") == text.count("<|im_start|>") and text.endswith("<|im_end|>\n")


def test_costs_and_rendering_against_brute_force(spark):
    pick = random.Random(3)
    given = {c: [pick.randint(0, 3) for _ in range(pick.randint(1, 5))] for c in range(60)}
    got = {}
    for r in sorted(chat.formatted(rows_of(spark, given)).collect(), key=lambda r: (r.conv_id, r.place)):
        cost, text = got.get(r.conv_id, (0, ""))
        got[r.conv_id] = (cost + r.cost, text + r.fragment)
    for c, roles in given.items():
        assert got[c][0] == brute_cost(roles), roles
        check_legal(got[c][1])
        assert [w for w in got[c][1].split() if w == "text"] == ["text"] * len(roles)


def test_a_conversation_over_many_partitions(spark):
    pick = random.Random(4)
    given = {1: [1, 2], 2: [pick.randint(0, 3) for _ in range(3000)], 3: [2, 1], None: [1]}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would go to one task
    try:
        split = chat.formatted(rows_of(spark, given, 6)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({r.place >> 32 for r in split if r.conv_id == 2}) > 1
    costs = chat.Costs()
    table = chat.steps(costs)
    for c, roles in given.items():
        rows = sorted((r for r in split if r.conv_id == c), key=lambda r: r.place)
        state, want = chat.START, 0
        for k, (role, _, _) in enumerate(chat._repair(roles, chat.START, None, table, costs)):
            want += table[roles[k]][state][role][0]
            state = role
        want += int(chat._ending(costs)[state])
        assert sum(r.cost for r in rows) == want
        check_legal("".join(r.fragment for r in rows))


def test_awkward_turns(spark):
    rows = [(1, None, None, None), (1, 0, " Human ", ""), (1, 0, " Human ", ""), (1, 1, "GPT", "x" * 50000), (None, None, "tool", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as place", "'c' as cost", "2 as h")
    got = chat.formatted(df).collect()
    assert len(got) == 5 and {r.role for r in got} <= set(chat.ROLES)
    for c in (1, None):
        check_legal("".join(r.fragment for r in sorted((r for r in got if r.conv_id == c), key=lambda r: r.place)))
    assert chat.formatted(df.where("false")).count() == 0
