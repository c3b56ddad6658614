import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from latewin.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort()
    paths = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 9
        paths[c] = tuple(t[2:] for t in own.get(c - c % 5, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in sorted(paths.items()):
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, below, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        own_saving = (len(m) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            below[node[:d]] += children[node] == 0
            saved[node[:d]] += own_saving
    return sorted(
        (
            m[0], len(node), members[node[:-1]][0] if node else None, len(m), children[node],
            below[node], saved[node],
            hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def result(df):
    columns = [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", "ends_sha256",
    ]
    assert df.columns == columns and all(k == "bigint" for _, k in df.dtypes[:-1])
    return sorted(map(tuple, df.collect()))


def talk(rng, convs, longest=12, texts=3):
    return [
        (c, t if rng.random() < 0.9 else None, rng.choice(["user", None]), rng.choice(["é a", "b", None, ""][:texts]))
        for c in convs
        for t in range(rng.randrange(1, longest))
    ]


@pytest.mark.parametrize("held", [1, 40, 10**6])
def test_equals_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(pt, "HELD_TURNS", held)
    monkeypatch.setattr(pt, "PIECE", 3)
    rng = random.Random(held)
    rows = talk(rng, [c for c in range(150) if c % 7], texts=4)
    # A third shares its first turns and ends together; one conversation is long.
    for c in range(1000, 1080):
        rows += [(c, t, "user", f"same {t}") for t in range(10)]
    rows += [(2003, t, "user", f"t{t % 3}") for t in range(90)]
    rows += [(None, 1, "user", "nobody's")] + rows[:20]
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    clash = table.withColumns({"pos": F.lit("x"), "depth": F.lit(1), "node": F.lit(2)})
    assert result(pt.prefix_trie(clash)) == brute(rows)


def test_turnless_and_single(spark):
    # A conversation whose group's first is absent and that is cut to nothing ends at the root.
    short = next(c for c in range(100) if crc32(str(c).encode()) % 9 >= 2 and c % 5)
    rows = [(short, 0, "user", "x")]
    assert result(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert len(brute(rows)) == 1


def test_empty(spark):
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(40))
def test_exit_nodes(seed):
    """Fat binary search finds the node and the depth that a walk down finds."""
    rng = random.Random(seed)
    trie, known = pt.ZFastTrie(), set()

    def digests(word):
        path = [pt.ROOT]
        for letter in word:
            path.append(hashlib.blake2b(path[-1] + letter.encode(), digest_size=16).digest())
        return path

    for _ in range(8):
        words = ["".join(rng.choices("ab", k=rng.randrange(40))) for _ in range(15)]
        words += [w[: len(w) // 2] + "b" for w in words[:5]] + words[:3]
        for word in words:
            path = digests(word)
            depth = max(d for d in range(len(path)) if d == 0 or path[d] in known)
            node, found = trie.exit_node(path)
            assert found == depth
            assert node.low < depth <= node.high or depth == 0 == node.high
        trie.insert([(k, digests(w), [1] * len(w)) for k, w in enumerate(words)])
        for word in words:
            known.update(digests(word)[1:])
    rows = list(trie.prefixes())
    assert {r[0] for r in rows} == known | {pt.ROOT} and len(rows) == len(known) + 1
    assert len(trie.handles) == len(trie.nodes) - 1


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 60):
            want = max(range(low + 1, high + 1), key=lambda d: d & -d)
            assert pt.two_fattest(low, high) == want
