"""The prefix trie against prefixes counted one by one, and the radix tree against a dictionary."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidefut.llm import prefix_trie, queries
from tidefut.llm.radix_tree import SIZES, RadixTree

CLASHES = "own string, above string, key string, turns string, n long, far long, size string"


def test_radix_tree_is_a_dictionary():
    rng, layouts = random.Random(2), set()
    for _ in range(60):
        tree, want = RadixTree(), {}
        for value in range(rng.choice([1, 5, 60, 1500])):
            key = bytes(rng.choices(range(rng.choice([2, 20, 256])), k=rng.randint(0, 6)))
            want[key] = value
            tree.insert(key, value)
        assert all(tree.get(k) == v and tree.get(k + b"x") == want.get(k + b"x") for k, v in want.items())
        found = list(tree.walk())
        assert sorted(n.value for n, *_ in found if n.value is not None) == sorted(want.values())
        for node, *_ in found:
            marks = [b for b, _ in node.items()]
            assert marks == sorted(marks) and node.size == next(s for s in (0, *SIZES) if s >= len(marks))
            layouts.add(node.size)
    assert layouts == {0, *SIZES}


def by_hand(convs):
    """Nodes of {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0) + sum(saved[k] for k in kids[path])
    return [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    ]


def table(spark, convs):
    rows = [(c, k, role, text, *[None] * 7) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, {CLASHES}").repartition(3)


def same(got, want):
    columns = [*prefix_trie.COUNTS, "ends_sha256"]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted(want, key=str)


def talks(seed, n):
    """Few different turns and openings, copies of one conversation, long ones and beginnings of others."""
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "assistant"]), rng.choice(["", "yes", "né", "🎉", "of the sea"]))
    hot = [turn() for _ in range(6)]
    out = {}
    for c in range(-3, n):
        kind = rng.random()
        out[c] = hot if kind < 0.35 else hot[: rng.randint(1, 6)] + [turn() for _ in range(rng.randint(0, 2))] if kind < 0.6 else [turn() for _ in range(rng.randint(1, 9))]
    out[n] = hot + [("user", f"turn {k}") for k in range(150)]
    out[n + 1] = out[n][:100] + [("user", "end")]
    return out


@pytest.mark.parametrize("limits", [(1, 1, 1), (4, 7, 10_000), (10_000, 9, 10_000), prefix_trie.LIMITS])
def test_blocks_of_all_sizes(spark, limits):
    convs = talks(3, 150)
    same(prefix_trie.trie(prefix_trie.sequences(table(spark, convs)), limits), by_hand(convs))


def test_openings_of_other_conversations(spark):
    convs = {c: t for c, t in talks(5, 420).items() if c not in (200, 201) and c >= 0}
    convs[100] = convs[100][:2]  # shorter than some openings; conversation 200 is absent
    want = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    assert [] in want.values()
    same(prefix_trie.trie(prefix_trie.with_openings(prefix_trie.sequences(table(spark, convs))), (30, 40, 10_000)), by_hand(want))


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "a", "x"), (1, 0, "a", "x"), (2, None, "", ""), (2, 1, "a", "x"), (None, 0, "a", "gone"), (3, 0, "ab", "x"), (4, 0, "a", "bx"), (5, 0, "a", "long " * 100_000)]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = by_hand({1: [("", ""), ("a", "x"), ("a", "x")], 2: [("", ""), ("a", "x")], 3: [("ab", "x")], 4: [("a", "bx")], 5: [("a", "long " * 100_000)]})
    same(prefix_trie.trie(prefix_trie.sequences(convs)), want)
    assert prefix_trie.trie(prefix_trie.sequences(convs.limit(0))).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs[r.conv_id].append((r.role or "", r.text or ""))
    want = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    got = queries.op12_prefix_trie(spark, sf)
    assert got.columns == [*prefix_trie.COUNTS, "ends_sha256"]
    same(got, by_hand(want))
