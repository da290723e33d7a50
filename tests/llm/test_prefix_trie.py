import hashlib
import random
import zlib

import pytest

from siftline.llm import prefix_trie
from siftline.llm.scan import scanned

SCHEMA = "conv_id long, turn long, role string, text string, conv string, depth int"


def by_conv(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(prefix_trie.NO_ID if conv is None else conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in out.items()}


def taken_over(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    worth = {k: (len(m) - 1) * len(k[-1][1].encode()) if k else 0 for k, m in members.items()}
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) if below else 1
        saved[k] = worth[k] + sum(saved[x] for x in below)
    rows = []
    for k, m in members.items():
        ended = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        rows.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(rows, key=repr)


def made():
    rnd = random.Random(5)
    rows = []
    for c in range(120):  # few texts, so that many conversations share beginnings
        rows += [(c, t, rnd.choice(["user", "assistant", None]) if t else "user", rnd.choice(["a", "b", "é", None])) for t in range(rnd.randrange(0, 9))]
    rows += [(200 + c, t, "user", f"t{t}") for c in range(40) for t in range(c)]  # each goes on where the last ends
    rows += [(400, t, "user", f"long {t % 7}") for t in range(900)] + [(405, t, "user", f"long {t % 7}") for t in range(901)]
    rows += [(500 + c, 0, "user", "same") for c in range(150)]
    rows += [(None, None, "user", "same"), (None, 3, None, None), (601, None, "user", "x"), (601, 0, "user", "y"), (10**15, 1, "user", "z" * 50_000)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("rebuilt", [False, True])
def test_trie(spark, rebuilt):
    rows = made()
    given = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(7)
    convs = by_conv(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turn_rows(given))) if rebuilt else prefix_trie.prefix_trie(given)
        assert sorted(map(tuple, found.collect()), key=repr) == brute(taken_over(convs) if rebuilt else convs)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_turnless_and_empty(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    hungry = next(c for c in range(1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    found = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turn_rows(spark.createDataFrame([(hungry, 0, "user", "x", None, None)], SCHEMA)))).collect()
    assert [tuple(r)[:7] for r in found] == [(hungry, 0, None, 1, 0, 1, 0)] and found[0].ends_sha256 == hashlib.sha256(str(hungry).encode()).hexdigest()


def test_colliding_digests_are_seen(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "b"), (2, 1, "user", "b")]
    turns = prefix_trie.turn_rows(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA))
    found = prefix_trie.prefixes(turns, turns.select("conv").distinct(), 0)
    assert prefix_trie.minima(found) is not None
    assert prefix_trie.minima(found.withColumn("g1", found.depth * 0).withColumn("g2", found.depth * 0)) is None


def test_a_group_over_many_partitions(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i % 5, i) for i in range(3000)], "g long, i long").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = scanned(rows, "g", ("i",), ("i",), "n long, total long", (0, 0), lambda s, x: (s[0] + 1, s[1] + x[0]), lambda a, b: (a[0] + b[0], a[1] + b[1])).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, state = {}, {}
    for g, i in sorted((1 if i % 3 else i % 5, i) for i in range(3000)):
        n, total = state.get(g, (0, 0))
        want[g, i] = state[g] = (n + 1, total + i)
    assert {(r.g, r.i): (r.n, r.total) for r in found} == want
