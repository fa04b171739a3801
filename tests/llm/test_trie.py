"""The conversation trie against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from orderloom.llm import trie
from orderloom.llm.queries import QUERIES

KINDS = "conv_id bigint, turn bigint, role string, text string, depth string, a int, `a.b` string"


def expected(rows):
    """Rows of the trie; turns that tie are equal in these tests, or their order makes no difference."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, trie_digest(role or "", text or ""), role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(found)] for c, found in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
    leaves, saved = Counter(), Counter()
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1]) if node else 0
    return {
        (min(convs), len(node)): (
            min(members[node[:-1]]) if node else None,
            len(convs),
            len(children[node]),
            leaves[node],
            saved[node],
            hashlib.sha256(",".join(map(str, sorted(c for c in convs if built[c] == node))).encode()).hexdigest(),
        )
        for node, convs in members.items()
    }


def trie_digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def check(spark, rows, found=None):
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], KINDS)
    got = trie.trie(table).collect()
    want = expected(rows)
    assert len(got) == len(want)
    assert {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got} == want


def drawn(seed, n, depth):
    chance = random.Random(seed)
    rows = []
    for c in chance.sample(range(n * 2), n):
        rows += [(c, t, chance.choice(["user", "bot"]), chance.choice(["a", "bb", "é🙂"])) for t in range(chance.randint(1, depth))]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    check(spark, drawn(seed, 120, 9))


def test_nulls_ties_and_copies(spark):
    rows = drawn(9, 40, 5) + [(None, 1, "user", "lost")] * 3
    rows += [(300, None, "user", "first"), (300, 2, None, None), (300, 2, "", ""), (300, -1, "user", "second")]
    rows += [(301, 1, "user", "t")] * 4 + [(302, t, "1", ":x") for t in range(3)] + [(303, t, "", "1::x") for t in range(3)]
    rows += [(700 + i, t, "user", f"same {t}") for i in range(80) for t in range(4)]
    check(spark, rows)


def test_common_first_turn(spark):
    rows = [(i, t, "user", "hello" if t == 0 else f"own {i} {t}") for i in range(200) for t in range(3)]
    check(spark, rows)


def test_one_long_conversation(spark):
    rows = [(5, t, "user", f"turn {t}") for t in range(700)] + [(i, t, "user", f"turn {t}") for i in range(6, 9) for t in range(0, 600 - i)]
    check(spark, rows + [(0, t, "user", f"turn {t}") for t in range(300)])


def test_small_bands(spark):
    paths = spark.createDataFrame([(1, d, 1) for d in range(20)] + [(2, d, 1 if d < 7 else 2) for d in range(20)], "c bigint, depth bigint, label bigint")
    own = spark.createDataFrame([(1, d, 1) for d in range(20)] + [(2, d, 1) for d in range(7, 20)], "conv_id bigint, depth bigint, n bigint")
    found = {(r["conv_id"], r["depth"]): r["n"] for r in trie.rolled_up(own, paths, 19, band=2).collect()}
    assert found == {(1, d): 20 - d + (13 if d < 7 else 0) for d in range(20)} | {(2, d): 20 - d for d in range(7, 20)}


def test_empty_table(spark):
    table = spark.createDataFrame([], KINDS)
    assert trie.trie(table).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op12_trie"](spark, folder).collect()
    assert {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in found} == expected(rows)
