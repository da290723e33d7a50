"""Conversation prefix trie: which conversations begin alike, how far, and what sharing those beginnings saves.

A node is a distinct sequence of the first d turns (role and text); its owner is the smallest conversation that begins so. A conversation that owns a
depth owns all below it, so its first owned depth is found by binary search: each round, all open conversations look one depth up
in the table of prefix digests and their smallest conversations. What a conversation owns is a chain of nodes; chains hang on
chains, at the depth above their first. Totals of chains are summed up this tree by doubling the distance each round, so a tree of height
t takes log2(t) rounds, and then along each chain from its end to its top.

Digests: a prefix is the value of a polynomial in its turns' SHA-256 over two prime fields, which can be put together from pieces; so a conversation with a third of
all turns is folded in many tasks (scan.py). The same aggregate that finds the minima shows whether two prefixes of one digest end
in different turns, which is so for the first depth at which two different prefixes collide; then all is done again with another seed.

Shuffles are of narrow rows: no text leaves the scan. Prefix minima, totals and counts are aggregates that combine before the shuffle, and joins
are against tables with one row a key, broadcast up to a checked size.

Edge cases: a null conv_id is the conversation 9223372036854775807; null roles and texts are empty; turns are ordered with null first, equal ones by their digest; repeated rows are turns like
any other; a conversation without turns of its own is a member of the root alone; an empty table has no nodes, not even the root; further columns aren't looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import ship, small, stored
from siftline.llm.scan import scanned

#: Field of the prefix polynomials.
PRIME = (1 << 61) - 1
NO_ID = (1 << 63) - 1
#: Characters of the blocks into which ids that end at one node are joined before they are hashed one after the other.
BLOCK_CHARS = 1 << 16
KEY = ("depth", "g1", "g2")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), t1, t2 (120 bits of the digest of role and text), bytes of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    conv = F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID))
    rows = conversations.select(conv.alias("conv"), "turn", part(1).alias("t1"), part(16).alias("t2"), F.octet_length(text).cast("long").alias("bytes"))
    placed = scanned(rows, "conv", ("turn", "t1", "t2"), (), "pos long", (0,), lambda s, _: (s[0] + 1,), lambda a, b: (a[0] + b[0],))
    return stored(placed.drop("turn"), "turns")


def taken_over(ident: Column) -> Column:
    """How many turns a conversation takes from the first of its five."""
    return F.crc32(ident.cast("string")) % 9


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns in which each conversation begins with the first turns of the first of its five, and all conversations (conv)."""
    base, h = F.col("conv") - F.col("conv") % 5, taken_over(F.col("conv"))
    convs = stored(turns.select("conv").distinct(), "convs")
    own = turns.filter((F.col("conv") == base) | (F.col("pos") > h))
    takers = convs.filter(F.col("conv") != base).select(F.col("conv").alias("taker"), base.alias("conv"), h.alias("most"))
    lent = turns.filter("pos <= 8").join(takers, "conv").filter("pos <= most").select(F.col("taker").alias("conv"), "t1", "t2", "bytes", "pos")
    return own.select("conv", "t1", "t2", "bytes", "pos").unionByName(lent), convs


def prefixes(turns: DataFrame, convs: DataFrame, seed: int) -> DataFrame:
    """conv, depth, g1, g2, t1, t2, bytes of each prefix, that of depth 0 included."""
    b1, b2 = (int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:7], "big") for i in (1, 2))

    def step(s, turn):
        return s[0] + 1, (s[1] * b1 + turn[0]) % PRIME, (s[2] * b2 + turn[1]) % PRIME

    def join(a, b):
        return a[0] + b[0], (a[1] * pow(b1, b[0], PRIME) + b[1]) % PRIME, (a[2] * pow(b2, b[0], PRIME) + b[2]) % PRIME

    rows = scanned(turns, "conv", ("pos",), ("t1", "t2"), "depth long, g1 long, g2 long", (0, 0, 0), step, join).drop("pos")
    none = [F.lit(0).cast("long").alias(c) for c in ("depth", "g1", "g2", "t1", "t2", "bytes")]
    return stored(rows.unionByName(convs.select("conv", *none)), "prefixes")


def minima(found: DataFrame) -> DataFrame | None:
    """depth, g1, g2, owner, n_convs, bytes of each node, or None if two prefixes share a digest."""
    alike = [f(c).alias(f"{n}_{c}") for c in ("t1", "t2") for n, f in (("least", F.min), ("most", F.max))]
    nodes = stored(found.groupBy(*KEY).agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), *alike), "nodes")
    if nodes.filter("least_t1 <> most_t1 OR least_t2 <> most_t2").limit(1).count():
        return None
    return nodes.select(*KEY, "owner", "n_convs", "bytes")


def first_owned(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv, length, first (depth from which it owns its prefixes, length + 1 if none), parent (owner of the depth above).

    Prefixes that one conversation alone has needn't be looked up: they are its own.
    """
    shared = small(stored(nodes.filter("n_convs > 1").select(*KEY, "owner"), "shared"))
    begin = found.groupBy("conv").agg(F.max("depth").alias("length")).select("conv", "length", F.lit(0).cast("long").alias("first"), (F.col("length") + 1).alias("until"), F.lit(None).cast("long").alias("parent"))
    state = stored(begin, "search")
    rounds = int(state.agg(F.max("until")).first()[0] or 0).bit_length()
    done = []
    for _ in range(rounds):
        done.append(state.filter("first >= until"))
        probe = small(stored(state.filter("first < until").withColumn("depth", F.expr("(first + until) div 2")), "probes"))
        met = found.select("conv", *KEY).join(probe, ["conv", "depth"]).join(shared, list(KEY), "left")
        other = F.col("owner") != F.col("conv")  # null where nobody else has the prefix
        state = stored(
            met.select(
                "conv", "length", F.when(other, F.col("depth") + 1).otherwise(F.col("first")).alias("first"), F.when(other, F.col("until")).otherwise(F.col("depth")).alias("until"), F.when(other, F.col("owner")).otherwise(F.col("parent")).alias("parent")
            ),
            "search",
        )
    for more in done:
        state = state.unionByName(more)
    return stored(state.drop("until"), "owned")


def chain_totals(chains: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv, parent, first, length, leaf (whether nothing hangs on its end), leaves and saved of each chain with all that hangs on it."""
    own = nodes.groupBy(F.col("owner").alias("conv")).agg(F.sum(F.expr("(n_convs - 1) * bytes")).alias("saved"))
    hung = chains.filter("parent IS NOT NULL").select(F.col("parent").alias("conv"), (F.col("first") - 1).alias("length")).distinct().withColumn("hung", F.lit(True))
    chains = stored(chains.join(own, "conv").join(hung, ["conv", "length"], "left").withColumn("leaf", F.when(F.col("hung"), 0).otherwise(1).cast("long")).drop("hung"), "chains")
    state = stored(chains.select("conv", F.col("parent").alias("above"), F.col("leaf").alias("leaves"), "saved"), "totals")
    while state.filter("above IS NOT NULL").limit(1).count():
        open_ = state.filter("above IS NOT NULL")
        given = open_.groupBy(F.col("above").alias("conv")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"))
        jump = small(stored(open_.select(F.col("conv").alias("above"), F.col("above").alias("next")), "jumps"))
        summed = state.join(given, "conv", "left").join(jump, "above", "left")
        state = stored(summed.select("conv", F.col("next").alias("above"), *[(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("leaves", "more"), ("saved", "more_saved"))]), "totals")
    return stored(chains.drop("saved").join(state.select("conv", "leaves", "saved"), "conv"), "chains")


def end_digests(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256 from (owner, depth, member): ids in order, joined by commas.

    SHA-256 takes its input in order, so the last step is one stream a node; by then the ids are joined to blocks, in as many tasks as it takes.
    """

    def blocks(batches):
        now, ids, size = None, [], 0
        for batch in batches:
            out = []
            for owner, depth, member in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if ids and ((owner, depth) != now or size > BLOCK_CHARS):
                    out.append((*now, ids[0], ",".join(map(str, ids))))
                    ids, size = [], 0
                now = (owner, depth)
                ids.append(member)
                size += 20
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["owner", "depth", "member", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, ids[0], ",".join(map(str, ids)))], ["owner", "depth", "member", "ids"])

    def digests(batches):
        now, sha = None, None
        for batch in batches:
            out = []
            for owner, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ids"))):
                if (owner, depth) == now:
                    sha.update(b"," + ids.encode())
                    continue
                if sha:
                    out.append((*now, sha.hexdigest()))
                now, sha = (owner, depth), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["owner", "depth", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, sha.hexdigest())], ["owner", "depth", "ends_sha256"])

    order = ("owner", "depth", "member")
    joined = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, "owner long, depth long, member long, ids string")
    return joined.repartition("owner", "depth").sortWithinPartitions(*order).mapInArrow(digests, "owner long, depth long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row a node. turns: conv, pos (any rising number), t1, t2, bytes; convs: conv, those without turns included."""
    turns = stored(turns, "turns")
    seed = 0
    while (nodes := minima(found := prefixes(turns, convs, seed))) is None:
        seed += 1
    owned = first_owned(found, nodes)
    chains = chain_totals(owned.filter("first <= length"), nodes)
    hung = chains.filter("parent IS NOT NULL").select(F.col("parent").alias("owner"), (F.col("first") - 1).alias("depth"), F.lit(1).cast("long").alias("hung"), "leaves", "saved")
    ends = chains.select(F.col("conv").alias("owner"), F.col("length").alias("depth"), F.lit(0).cast("long").alias("hung"), F.col("leaf").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    given = hung.unionByName(ends).groupBy("owner", "depth").agg(*[F.sum(c).alias(c) for c in ("hung", "leaves", "saved")])
    tops = chains.select(F.col("conv").alias("owner"), F.col("first").alias("depth"), "parent", F.lit(True).alias("top"))
    # A node is named by owner and depth; every join is on both, so a long chain spreads like other rows.
    rows = nodes.select("owner", "depth", "n_convs", "bytes").join(given, ["owner", "depth"], "left").join(tops, ["owner", "depth"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.select("owner", (-F.col("depth")).alias("up"), "n_convs", F.when(F.col("top"), F.col("parent")).otherwise(F.col("owner")).alias("parent"), zero("hung").alias("hung"), zero("leaves").alias("leaves"), (zero("saved") + F.expr("(n_convs - 1) * bytes")).alias("saved"))
    summed = scanned(rows, "owner", ("up",), ("leaves", "saved"), "below long, n_leaves long, saved_tokens long", (0, 0, 0), lambda s, x: (s[0] + 1, s[1] + x[0], s[2] + x[1]), lambda a, b: tuple(map(sum, zip(a, b))))
    members = chains.select(F.col("conv").alias("owner"), F.col("length").alias("depth"), F.col("conv").alias("member")).unionByName(owned.filter("first > length").select(F.col("parent").alias("owner"), F.col("length").alias("depth"), F.col("conv").alias("member")))
    shas = end_digests(members)
    out = summed.withColumn("depth", -F.col("up")).join(shas, ["owner", "depth"], "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", (F.col("hung") + F.when(F.col("below") > 1, 1).otherwise(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    turns = turn_rows(conversations)
    return trie(turns, stored(turns.select("conv").distinct(), "convs"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return trie(*rebuilt(turn_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


ORACLE_OP11 = r"""
WITH polynomial AS (
  SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS t(i))
), t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), ids AS (
  SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')]), lambda r, b: xor(crcs[xor(r, b) % 256 + 1], r // 256)), 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM t), polynomial
), r AS (
  SELECT i.c, t.pos, role, text FROM ids i JOIN t ON t.c = i.c WHERE i.c = i.base OR pos > h
  UNION ALL SELECT i.c, t.pos, role, text FROM ids i JOIN t ON t.c = i.base WHERE i.c <> i.base AND pos <= h
), p AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ORDER BY pos) OVER (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS k, strlen(text) AS bytes FROM r
  UNION ALL SELECT c, 0, '', 0 FROM ids
), n AS (
  SELECT d, k, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS worth FROM p GROUP BY d, k
), up AS (
  SELECT DISTINCT n.d, n.k, q.k AS above FROM n JOIN p ON n.d = p.d AND n.k = p.k JOIN p q ON q.c = p.c AND q.d = p.d - 1
), kids AS (
  SELECT d - 1 AS d, above AS k, count(*) AS n FROM up GROUP BY ALL
), tops AS (
  SELECT DISTINCT a.d, a.k, n.d AS below, n.k AS below_k, worth, kids.n IS NULL AS leaf FROM n JOIN p ON p.c = n.c AND p.d = n.d JOIN p a ON a.c = n.c AND a.d <= n.d LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k
), under AS (
  SELECT d, k, sum(worth) AS saved, count(*) FILTER (leaf) AS leaves FROM tops GROUP BY ALL
), lengths AS (
  SELECT c, max(d) AS d, arg_max(k, d) AS k FROM p GROUP BY c
), ends AS (
  SELECT d, k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM lengths GROUP BY ALL
)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, parent.c AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, under.leaves AS n_leaves, under.saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN under ON under.d = n.d AND under.k = n.k LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k LEFT JOIN up ON up.d = n.d AND up.k = n.k LEFT JOIN n parent ON parent.d = n.d - 1 AND parent.k = up.above LEFT JOIN ends ON ends.d = n.d AND ends.k = n.k
"""
