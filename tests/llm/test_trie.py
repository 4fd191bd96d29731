"""Prefix trie against a brute-force trie."""

import hashlib
import random
import zlib
from collections import defaultdict

from ledgerlens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, T1 string, level int, block long, id string"


def brute(rows, group=20, most=4):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())} {role} {text}".encode()).digest()
            convs[c].append((turn is not None, turn or 0, digest, role, text))
    for c in convs:
        convs[c].sort()
        convs[c] = [t[3:] for t in convs[c]]
    built = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % most
        source = c - (abs(c) % group) * (1 if c >= 0 else -1)
        built[c] = tuple(convs.get(source, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        own = (len(m) - 1) * len([w for w in p[-1][1].replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += not kids[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def spark_rows(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=repr)


def test_edge_rows(spark):
    rows = [(1, 0, "user", "hi there"), (1, 1, None, None), (1, None, "system", "null turn  first"), (2, 0, "user", "hi there"), (2, 0, "user", "hi there"),
            (None, 0, "user", "nobody's"), (0, 5, "a", "b c"), (0, 4, "ab", "c"), (20, 0, "", ""), (21, 0, "u", "only one"), (-7, 1, "u", "negative"), (-7, 1, "u", "tie"),
            (3, 0, "user", "w " * 50_000), (4, 0, "user", "w " * 50_000), (40, 0, "a", "b"), (59, 9, "a", "b"), (5, 0, "a\x1f", "b\x0bc\x0cd\te\nf\rg\x1ch i")]
    assert spark_rows(spark, rows) == brute(rows)


def test_empty(spark):
    assert spark_rows(spark, []) == []


def test_turnless_conversations_belong_to_the_root(spark):
    turnless = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1][:3]     # their one turn goes and conversation 20 is absent
    got = spark_rows(spark, [(c, 0, "u", "t") for c in turnless])
    assert got == brute([(c, 0, "u", "t") for c in turnless]) and got[0][1] == 0 and got[0][3] == 3


def test_long_conversations_cross_blocks(spark):
    """Conversations of 0 to 90 turns that branch at, before and behind the ends of blocks."""
    rnd = random.Random(5)
    rows = []
    for c in range(60):
        length = rnd.choice([0, 1, 3, 7, 8, 9, 15, 16, 17, 24, 33, 64, 90])
        branch = rnd.choice([0, 4, 7, 8, 9, 16, 20, 32, 100])
        for t in range(length):
            rows.append((c * 7, t, "user" if t % 2 else "bot", f"shared turn {t}" if t < branch else f"own {c % 4} {t} word"))
    assert spark_rows(spark, rows) == brute(rows)


def test_one_conversation_and_one_turn_hold_most_rows(spark):
    """Partitions cut a conversation of many turns, many of them equal."""
    rows = [(5, t // 3, "u", f"turn {t % 2}") for t in range(400)] + [(c, 0, "u", "common first") for c in range(100, 400)]
    rows += [(c, 1, "u", f"second {c}") for c in range(100, 400)]
    assert spark_rows(spark, rows, 7) == brute(rows)


def test_table_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert spark_rows(spark, rows) == brute(rows)
