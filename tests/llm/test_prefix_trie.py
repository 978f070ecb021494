"""The trie against one built from dictionaries, and its running totals."""

import hashlib
import random
import zlib

import pytest
from llm.llm_support import SF
from pyspark.sql import functions as F

from arrearly.llm import prefix_trie, queries
from arrearly.llm.running import running_totals

SCHEMA = "conv_id long, turn long, role string, text string"


def place(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    digest = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()
    return (turn is not None, turn or 0, role.encode(), int(digest[:15], 16), int(digest[16:31], 16))


def brute(rows):
    """{(conv_id, depth): all other columns}."""
    turns = {}
    for r in sorted((r for r in rows if r[0] is not None), key=place):
        turns.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
    members = {}
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    out = {}
    for path in sorted(members, key=len, reverse=True):
        leaves, saved = 0, (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        for child in children.get(path, []):
            below = out[min(members[child]), len(child)]
            leaves += below[3]
            saved += below[4]
        ends = ",".join(str(c) for c in sorted(members[path]) if whole[c] == path)
        out[min(members[path]), len(path)] = (
            min(members[path[:-1]]) if path else None, len(members[path]), len(children.get(path, [])),
            leaves or 1, saved, hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def assert_trie(found, rows):
    got = found.collect()
    assert len({(r.conv_id, r.depth) for r in got}) == len(got)
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got} == brute(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert_trie(queries.QUERIES["op13_prefix_trie"](spark, SF), rows)


def test_odd_rows(spark):
    """NULLs in every column, ties, repeats, negative and very large ids, many equal paths."""
    rng = random.Random(2)
    ids = [None, *range(-7, 40), 2**63 - 1, -(2**63)]
    rows = [
        (
            rng.choice(ids), rng.choice([None, None, *range(-2, 9)]),
            rng.choice(["user", "assistant", "", None]), rng.choice(["a", "", None, "é日", "a:b"]),
        )
        for _ in range(400)
    ]
    messages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "2 AS kid", "3 AS `my col`")
    # The first of all ids has no family head: it would lie below the range.
    assert_trie(prefix_trie.prefix_trie(messages.repartition(3)), rows)


def test_no_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    only = spark.createDataFrame([(None, 1, "user", "a")], SCHEMA)
    assert prefix_trie.prefix_trie(only).count() == 0


def test_chains_and_fans(spark):
    """A conversation of 300 turns, a fan at the root, a caterpillar, many equal ones."""
    rows = [(100, t, "user", f"t{t}") for t in range(300)]
    rows += [(c, 0, "user", f"only {c}") for c in range(200, 260)]
    rows += [(c, t, "user", f"spine {t}") for c in range(300, 340) for t in range(c - 290)]
    rows += [(c, t, "user", f"same {t}") for c in range(400, 440) for t in range(12)]
    messages = spark.createDataFrame(rows, SCHEMA)
    assert_trie(prefix_trie.prefix_trie(messages), rows)


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """A chain of 2,000 nodes takes few rounds."""
    tables = []
    real = prefix_trie.written
    monkeypatch.setattr(prefix_trie, "written", lambda df: tables.append(1) or real(df))
    chain = spark.range(2000).selectExpr(
        "1L AS conv", "id AS depth", "IF(id > 0, 1L, NULL) AS up", "1L AS n_convs",
        "1L AS own", "CAST(NULL AS binary) AS ends",
    )
    found = prefix_trie.subtree_totals(chain)
    assert {r.depth: (r.leaves, r.saved) for r in found.collect()} == {d: (1, 2000 - d) for d in range(2000)}
    assert len(tables) <= 2 * 14


def test_lists_in_pieces(spark, monkeypatch):
    """Ends of one node that fill several fragments."""
    monkeypatch.setattr(prefix_trie, "_FRAGMENT", 20)
    rows = [(c, 0, "user", "a") for c in range(0, 1000, 3)]
    assert_trie(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(4)), rows)


@pytest.mark.parametrize("groups", [1, 3, 500])
def test_running_totals(spark, groups):
    """Groups that fill tasks, reach over some, and lie within one."""
    rng = random.Random(groups)
    rows = [(rng.randrange(groups), i, rng.randrange(2**62)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, i long, x long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = running_totals(df.withColumn("one", F.lit(1)), ["g"], ["i"], {"n": "one", "s": "x"})
        found = {(r.g, r.i): (r.n, r.s) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums, want = {}, {}
    for g, i, x in sorted(rows):
        n, s = sums.get(g, (0, 0))
        sums[g] = want[g, i] = (n + 1, (s + x) % 2**62)
    assert found == want
