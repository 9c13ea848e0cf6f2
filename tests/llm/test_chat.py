import random
from itertools import product

from tallyward.llm import chat as c

SCHEMA = "conv_id long, turn long, role string, text string, chunk int"


def brute(turns, costs):
    """Least cost over every choice of roles and merges."""
    best = None
    for roles in product((c.SYSTEM, c.USER, c.ASSISTANT), repeat=len(turns)):
        for merges in product((False, True), repeat=len(turns)):
            state, cost, ok = c.START, 0.0, True
            for (was, blank), to, merge in zip(turns, roles, merges):
                cost += 0 if was == to else costs.unknown if not was else costs.demote if (was, to) == (c.SYSTEM, c.USER) else costs.relabel
                if merge:
                    ok &= state == to
                    cost += costs.blank if blank else costs.merge
                else:
                    gap = c._GAP[state, to]
                    ok &= gap is not None
                    cost += costs.insert * len(gap or ())
                state = to
            if ok:
                cost += c.end_cost(state, costs)
                best = cost if best is None else min(best, cost)
    return best


def cost_of(turns, path, costs):
    state, cost = c.START, 0.0
    for (was, blank), (to, merged, gap) in zip(turns, path):
        cost += 0 if was == to else costs.unknown if not was else costs.demote if (was, to) == (c.SYSTEM, c.USER) else costs.relabel
        cost += (costs.blank if blank else costs.merge) if merged else costs.insert * len(gap)
        state = to
    return cost + c.end_cost(state, costs)


def test_repair_is_cheapest_and_chunks_agree():
    rng = random.Random(1)
    for _ in range(120):
        turns = [(rng.randint(0, 3), rng.random() < 0.2) for _ in range(rng.randint(1, 5))]
        costs = c.Costs(*[rng.choice([0.25, 1.0, 2.0, 3.5]) for _ in range(6)])
        want = brute(turns, costs)
        assert abs(cost_of(turns, c.repair(turns, costs=costs), costs) - want) < 1e-9
        k = rng.randint(0, len(turns))
        matrices = []
        for part in (turns[:k], turns[k:]):
            m = c.IDENTITY
            for role, blank in part:
                m = c.product(m, role, blank, costs)
            matrices.append(m)
        (a, b), (b2, d) = c.borders(matrices, costs)
        path = c.repair(turns[:k], a, b, costs) + c.repair(turns[k:], b2, d, costs)
        assert abs(cost_of(turns, path, costs) - want) < 1e-9


def rendered(rows):
    return "".join(r.rendered for r in sorted(rows, key=lambda r: (r.chunk, r.n)))


def legal(text):
    roles = [p.split("|>")[0] for p in text.split("<|")[1:] if not p.startswith("end|>")]
    body = roles[1:] if roles[:1] == ["system"] else roles
    return body == ["user", "assistant"] * (len(body) // 2) and text.count("<|end|>") == len(roles)


def test_conversations(spark):
    rows = [
        (1, 0, "system", "s", 0), (1, 1, "user", "hi", 0), (1, 2, "assistant", "hello", 0),
        (2, 0, "user", "a", 0), (2, 1, "user", "b", 0), (2, 2, "assistant", "c", 0), (2, 3, "user", "d", 0),
        (3, 0, "assistant", "starts", 0), (4, 0, None, "who", 0), (4, 1, "bot", None, 0), (4, None, "HUMAN ", "first <|end|> of all", 0),
        (None, 0, "user", "alone", 0), (None, 0, "user", "alone", 0), (5, 0, "user", "x", 0), (5, 0, "user", "x", 0), (5, 1, "system", "late", 0),
    ]
    rows += [(6, i, "user" if i % 2 == 0 or i % 7 == 0 else "assistant", f"t{i}", 0) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, parts = ([r for r in c.format_chats(df, chunk=k).collect()] for k in (4096, 16))
    for got in (whole, parts):
        texts = {}
        for r in got:
            texts.setdefault(r.conv_id, []).append(r)
        assert rendered(texts[1]) == "<|system|>\ns<|end|>\n<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n"
        assert rendered(texts[2]) == "<|user|>\na\n\nb<|end|>\n<|assistant|>\nc<|end|>\n<|user|>\nd<|end|>\n<|assistant|>\n<|end|>\n"
        assert rendered(texts[3]) == "<|user|>\n<|end|>\n<|assistant|>\nstarts<|end|>\n"
        assert "first < |end|> of all" in rendered(texts[4])
        assert all(legal(rendered(texts[k])) for k in (1, 2, 3, 4, 5, 6))
        assert sum(r.action == "end" for r in texts[None]) == 2
        assert sum(r.turn is not None for r in got if r.conv_id == 6) == 500
    assert rendered([r for r in whole if r.conv_id == 6]).count("user") == rendered([r for r in parts if r.conv_id == 6]).count("user")
    assert c.format_chats(df.limit(0)).count() == 0


def test_turns_without_numbers_are_many_chunks(spark):
    rows = [(9, None if i % 2 else 3, "user", f"{i:04}" if i % 3 else "same", 0) for i in range(400)] + [(10, 0, "user", "long " * 300_000, 0)]
    got = c.format_chats(spark.createDataFrame(rows, SCHEMA), chunk=32).collect()
    of = lambda k: [r for r in got if r.conv_id == k]
    assert len({r.chunk for r in of(9)}) >= 400 / 32 and legal(rendered(of(9)))
    assert [r.turn for r in sorted(of(9), key=lambda r: (r.chunk, r.n)) if r.action in ("keep", "merge")] == [None] * 200 + [3] * 200
    assert rendered(of(10)).count("long ") == 300_000 and {r.chunk for r in of(10)} <= {0, 1}
    one = c.format_chats(spark.createDataFrame(rows, SCHEMA)).where("conv_id = 9").collect()
    assert rendered(one) == rendered(of(9))
