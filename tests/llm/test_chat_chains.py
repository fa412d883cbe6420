"""Orders of dependent calls: long chains in few rounds, and random graphs against a plain recursion."""
import random

from tidemill.llm import chat


def brute(calls, edges):
    """(order_turn, level, cycle) of each (conv, id)."""
    turn, needs = {(c, i): t for c, i, t in calls}, {}
    for c, i, n in edges:
        if (c, n) in turn:
            needs.setdefault((c, i), set()).add((c, n))
    found, moved = {k: (t, 0, False) for k, t in turn.items() if k not in needs}, True
    while moved:
        moved = False
        for k, on in needs.items():
            if k not in found and all(x in found for x in on):
                t, level = max(found[x][:2] for x in on)
                found[k], moved = ((t, level + 1, False) if t >= turn[k] else (turn[k], 0, False)), True
    return {k: found.get(k, (t, 0, True)) for k, t in turn.items()}


def ours(spark, calls, edges):
    got = chat.levels(spark.createDataFrame(calls, "conv_id long, id string, turn int"), spark.createDataFrame(edges, "conv_id long, id string, needs string"))
    return {(r["conv_id"], r["id"]): (r["order_turn"], r["level"], r["cycle"]) for r in got.collect()}


def test_chains_of_a_thousand_take_few_rounds(spark, monkeypatch):
    random.seed(3)
    rounds, real = [], chat.stored
    monkeypatch.setattr(chat, "stored", lambda df, name, **m: (rounds.append(name), real(df, name, **m))[1])
    n = 1000
    calls = [(c, f"c{i}", t) for c, order in ((1, range(n)), (2, range(n, 0, -1)), (3, random.choices(range(50), k=n))) for i, t in enumerate(order)]
    edges = [(c, f"c{i}", f"c{i - 1}") for c in (1, 2, 3) for i in range(1, n)]
    assert ours(spark, calls, edges) == brute(calls, edges)
    assert rounds.count("settled") - 1 <= 12


def test_random_graphs(spark):
    random.seed(4)
    calls, edges = [], []
    for conv in range(60):
        n = random.randint(1, 14)
        calls += [(conv, f"c{i}", random.randint(0, 6)) for i in range(n)]
        for i in range(n):
            for j in random.sample(range(n), min(n, random.choice([0, 1, 1, 1, 2, 3]))):
                if j < i or random.random() < 0.04:  # now and then a circle
                    edges.append((conv, f"c{i}", f"c{j}"))
        edges.append((conv, "c0", "nobody"))
    assert ours(spark, calls, sorted(set(edges))) == brute(calls, edges)
