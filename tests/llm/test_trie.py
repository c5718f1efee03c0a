import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pagelore.llm.trie import Parentheses, prefix_trie

TURNS = "conv_id long, turn int, role string, text string"


def brute(rows):
    given = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            given[conv].append((turn is not None, turn or 0, role or "", text or ""))
    rebuilt = {}
    for conv, turns in given.items():
        h = zlib.crc32(str(conv).encode()) % 6
        head = sorted(given.get(conv - conv % 100, []))[:h]
        rebuilt[conv] = tuple(t[2:] for t in head + sorted(turns)[h:])
    members, children, leaves, tokens = defaultdict(list), defaultdict(set), defaultdict(int), defaultdict(int)
    for conv, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
            if d:
                children[turns[:d - 1]].add(turns[:d])
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            tokens[node[:d]] += (len(convs) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if rebuilt[c] == node)))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, ())),
                    leaves[node], tokens[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_findclose_on_random_sequences():
    rng = random.Random(2)
    for size in (1, 2, 31, 32, 33, 64, 500, 5000):
        parens, depth, left = [], 0, size
        while left or depth:
            if left and (depth == 0 or rng.random() < (0.9 if size % 2 else 0.5)):
                parens, depth, left = parens + [True], depth + 1, left - 1
            else:
                parens, depth = parens + [False], depth - 1
        stack, wanted = [], {}
        for i, opening in enumerate(parens):
            if opening:
                stack.append(i)
            else:
                wanted[stack.pop()] = i
        opens = np.array(sorted(wanted))
        assert Parentheses(np.array(parens)).findclose(opens).tolist() == [wanted[i] for i in opens]


@pytest.mark.parametrize("shard_turns", [30, 1 << 15])
def test_nodes_equal_a_dictionary_trie(ready, shard_turns):
    rng = random.Random(3)
    rows = []
    for conv in [*range(60), *range(101, 140), *range(200, 260), 7_000_000_001]:     # no conversation 100
        for turn in range(rng.randint(1, 7)):
            text = rng.choice(["x", "yy", "", None, "héé😀"]) if conv % 3 else "same"
            rows.append((conv, None if rng.random() < 0.05 else turn, rng.choice(["u", "a", None]), text))
    rows += rows[:20] + [(None, 1, "u", "nobody's"), (3, 0, "u", "z tie"), (3, 0, "u", "a tie")]
    assert rows_of(prefix_trie(ready.createDataFrame(rows, TURNS), shard_turns)) == brute(rows)


def test_equal_conversations_over_many_shards_and_a_long_one(ready):
    rows = [(100 * c, t, "u", f"turn {t}") for c in range(300) for t in range(3)]
    rows += [(50_000, t, "a", "long" * (t % 3)) for t in range(700)] + [(60_001, 0, "u", "alone")]
    frame = ready.createDataFrame(rows, TURNS).selectExpr("*", "1 AS key", "2 AS depth", "3 AS n_convs")
    assert rows_of(prefix_trie(frame, 200)) == brute(rows)


def test_empty_and_turnless(ready):
    assert prefix_trie(ready.createDataFrame([], TURNS)).count() == 0
    gone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 0)
    rows = [(gone, 0, None, None)]
    assert rows_of(prefix_trie(ready.createDataFrame(rows, TURNS))) == brute(rows) == [
        (gone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(gone).encode()).hexdigest())]
