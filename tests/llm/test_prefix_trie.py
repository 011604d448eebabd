import hashlib
import math
import random
import re
import zlib

import pytest

from tablejury.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, tid string, pos int, block string, key int, depth int"


def numbered(rows):
    """conv_id -> its (role, text) turns in order."""
    said = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        said.setdefault(c, []).append((role or "", text or ""))
    return said


def rebuilt(said):
    return {c: said.get(c - int(math.fmod(c, 20)), [])[:zlib.crc32(str(c).encode()) % 4] + turns[zlib.crc32(str(c).encode()) % 4:] for c, turns in said.items()}


def brute(said):
    nodes = {}
    for c, turns in said.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[p] for p in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        saved[path] = sum(saved[p] for p in below) + (len(nodes[path]) - 1) * words
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), len(children.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(said[c]) == len(p)).encode()).hexdigest()) for p, m in nodes.items())


def ours(spark, rows, rebuild=True, width=8):
    df = spark.createDataFrame([(*r, "t", 1, "b", 2, 3) for r in rows], SCHEMA)
    turns = prefix_trie.turns(df.repartition(3))
    trie = prefix_trie.trie(prefix_trie.shared_heads(turns) if rebuild else prefix_trie.as_they_are(turns), width)
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in trie.collect())


def drawn(seed, conversations, longest, words):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(words)) for c in conversations for t in range(rng.randint(1, longest))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rebuild, width", [(True, 8), (False, 2), (True, 3)])
def test_equal_to_brute_force(spark, rebuild, width):
    rows = drawn(width, list(range(60)) + [107, 213, 214], 7, ["a", "b c", ""])
    said = numbered(rows)
    assert ours(spark, rows, rebuild, width) == brute(rebuilt(said) if rebuild else said)


def test_long_conversations_and_copies_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 4)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    long = [(str(k % 3), f"word {k}") for k in range(100)]
    said = {1: long, 2: long, 3: long[:64], 4: long[:65], 5: long[:63] + [("x", "other")] * 20, 6: long[:8], 7: long[:16], 8: long[:16], **{c: long[:9] for c in range(20, 60)}}
    rows = [(c, t, *turn) for c, turns in said.items() for t, turn in enumerate(turns)]
    assert ours(spark, rows, rebuild=False) == brute(said)
    assert ours(spark, rows) == brute(rebuilt(numbered(rows)))


def test_awkward_rows(spark):
    big = "word " * 30_000
    rows = [(0, None, None, None), (0, 0, "user", "x"), (0, 0, "user", "x"), (0, 0, "user", "w"), (1, 5, None, "y"), (1, -2, "user", big), (2, 1, "user", ""),
            (None, 1, "user", "x"), (3, 1, "a:b", "c"), (4, 1, "a", "b:c"), (-7, 1, "user", "x"), (43, 1, "user", "one"), (2**62, 3, "u", "é 😀 z"), (40, 1, "user", "one")]
    assert ours(spark, rows) == brute(rebuilt(numbered(rows)))
    assert ours(spark, rows, rebuild=False) == brute(numbered(rows))
    assert ours(spark, []) == [] and ours(spark, [(None, 1, "a", "b")]) == []
    assert ours(spark, [(3, 0, "a", "b")]) == brute(rebuilt(numbered([(3, 0, "a", "b")])))  # left without turns or with its own
