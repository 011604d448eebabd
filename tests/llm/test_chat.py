import re
from collections import defaultdict

from tablejury.llm import chat


def brute(chosen, rejected):
    sides = []
    for rows in (chosen, rejected):
        said = defaultdict(dict)
        for pair, turn, role, text in rows:
            if pair is not None and turn is not None:
                new = (role or "", text or "")
                said[pair][turn] = min(said[pair].get(turn, new), new)
        sides.append(said)
    out = []
    for pair in set(sides[0]) | set(sides[1]):
        c, r = sides[0].get(pair, {}), sides[1].get(pair, {})
        cut = min((t for t in set(c) | set(r) if c.get(t) != r.get(t)), default=None)
        for part, turns in (("prompt", {t: x for t, x in c.items() if cut is None or t < cut}),
                            ("chosen", {t: x for t, x in c.items() if cut is not None and t >= cut}),
                            ("rejected", {t: x for t, x in r.items() if cut is not None and t >= cut})):
            out += [(pair, part, t, role, f"<|{role}|>\n{text}<|end|>\n", part != "prompt" and role == "assistant")
                    for t, (role, text) in turns.items()]
    return sorted(out)


CHOSEN = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "yes"),
          (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", "only chosen"), (5, 0, None, None), (5, 0, "user", "tie"),
          (6, 0, "user", "x"), (6, 0, "user", "x"), (None, 0, "user", "no pair"), (7, None, "user", "no turn"), (8, 0, "user", "l" * 100_000)]
REJECTED = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "other"), (1, 3, "assistant", "no"), (1, 4, "user", "longer"),
            (2, 0, "user", "same"), (2, 1, "assistant", "same"), (4, 0, "user", "only rejected"), (5, 0, None, ""), (6, 0, "user", "x"),
            (8, 0, "user", "l" * 100_000 + "!")]
SCHEMA = "pair_id long, turn long, role string, text string"


def run(spark, chosen, rejected):
    c, r = (spark.createDataFrame([(*x, 1, "y") for x in rows], SCHEMA + ", cut int, part string") for rows in (chosen, rejected))
    return sorted(tuple(x) for x in chat.preference_pairs(c, r).collect())


def test_awkward_pairs(spark):
    assert run(spark, CHOSEN, REJECTED) == brute(CHOSEN, REJECTED)
    assert run(spark, [], []) == [] and run(spark, CHOSEN, []) == brute(CHOSEN, [])


def test_one_pair_with_most_rows(spark):
    chosen = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(5000)]
    rejected = chosen[:3999] + [(1, 3999, "assistant", "another")]
    assert run(spark, chosen, rejected) == brute(chosen, rejected)


def test_swapped_replies(spark):
    talk = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (1, 0, "user", "p"), (1, 1, "assistant", "a1"), (2, 0, "assistant", "alone"),
            (4, 0, "user", "no reply"), (5, 0, "assistant", "x"), (5, 1, "user", "bye")]
    chosen, rejected = chat.swapped_replies(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, chosen.collect())) == talk
    assert sorted(map(tuple, rejected.collect())) == [(0, 0, "user", "q"), (0, 1, "assistant", "a1"), (1, 0, "user", "p"), (1, 1, "assistant", "a0"),
                                                      (4, 0, "user", "no reply"), (5, 1, "user", "bye")]


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([(0, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    plan = chat.preference_pairs(*chat.swapped_replies(rows))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
