"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from functools import cache
from itertools import product

import numpy as np
import pytest
from llm.llm_support import SF
from pyspark.sql import functions as F

from arrearly.llm import queries, repair

NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def damaged(rows):
    """Rows (conv_id, turn, role, text) after the damage of the contract."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def in_order(rows):
    return sorted(
        rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest())
    )


def best(rows, insert=5, delete=2, rerole=1, cut=5):
    """(cost, audit) of the cheapest edits of (initial, fault) rows, by trying all of them."""

    @cache
    def go(i, state, inserted):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, ""))
        if inserted < 2:
            new = "a" if state == "u" else "u"
            c, a = go(i, new, inserted + 1)
            options.append((c + insert, "I" + a))
        if i < len(rows):
            initial, fault = rows[i]
            c, a = go(i + 1, state, 0)
            options.append((c + delete, "D" + a))
            if fault not in ("blank", "duplicate"):
                extra = cut if fault == "truncated" else 0
                if initial and initial in NEXT[state]:
                    c, a = go(i + 1, initial, 0)
                    options.append((c + extra, "K" + a))
                c, a = go(i + 1, "a" if state == "u" else "u", 0)
                options.append((c + extra + rerole, "R" + a))
        return min(options, default=(10**9, ""))

    return go(0, "", 0)


def expected(rows):
    """The report of one conversation's rows after damage."""
    rows = in_order(rows)
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append(
            "blank" if not body else "duplicate" if (role, text) in seen
            else "truncated" if body[-1] not in ".!?" else None
        )
        seen.add((role, text))
    turns = {r[1] for r in rows if r[1] is not None}
    initials = [r[2][:1] for r in rows]
    cost, audit = best(tuple(zip(initials, faults)))
    lines, state, left = [], "", iter(rows)
    for letter in audit:
        row = next(left) if letter != "I" else (None, None, "", "")
        if letter == "D":
            continue
        state = row[2][0] if letter == "K" else "a" if state == "u" else "u"
        lines.append((row[2] if letter == "K" else FULL[state]) + ":" + row[3])
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    return dict(
        gaps=max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        illegal=sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost=cost,
        audit=audit,
        repaired_sha256=hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def assert_reports(found, rows, damage=True):
    found = {r.conv_id: r.asDict() for r in found.collect()}
    groups = by_conversation(rows)
    assert found.keys() == groups.keys()
    for conv, group in groups.items():
        want = expected(damaged(group) if damage else group)
        assert found[conv] == {"conv_id": conv} | want, conv


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    found = queries.QUERIES["op12_block_table_repair"](spark, SF)
    assert_reports(found, [tuple(r) for r in rows])


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "tool", "", None, "Ü", "s", "unknown"]
    texts = ["a.", "b!", "c", " \t\x0b", "", None, "d? ", "é。", "a.", "x\ny."]
    return [
        (
            rng.choice([None, *range(-3, 40)]),
            rng.choice([None, None, *range(-2, 9), 2**40]),
            rng.choice(roles[:3] if rng.random() < 0.7 else roles),
            rng.choice(texts),
        )
        for _ in range(600)
    ] + [(77, t, "user", "again.") for t in range(50)] * 2 + [(78, None, None, None)]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_odd_rows(spark, odd_rows):
    """NULLs in every column, ties, repeats, other roles, a text that fills a conversation."""
    frame = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    messages = repair.damaged(frame)
    found = repair.digested(messages, repair.reports(messages, times="times"), times="times")
    assert_reports(found, odd_rows)


def test_without_damage(spark, odd_rows):
    clean = [(c, t, r or "x", x or "") for c, t, r, x in odd_rows]
    messages = spark.createDataFrame(clean, SCHEMA).selectExpr("*", "1 AS times", "2 AS gaps", "3 AS `my col`")
    assert_reports(repair.digested(messages, repair.reports(messages)), clean, damage=False)


def test_empty_and_all_dropped(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.digested(none, repair.reports(none)).count() == 0
    gone = spark.createDataFrame([(1, 0, "user", "a.", 0)], SCHEMA + ", times long")
    r = repair.digested(gone, repair.reports(gone, times="times"), times="times").collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(x) for x in r] == [(1, 0, 0, 0, 0, 0, 0, "", empty)]


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "system", "c."), (2, 0, "assistant", "long " * 50000)]
    messages = spark.createDataFrame(rows, SCHEMA)
    made = repair.repaired(messages, repair.reports(messages)).orderBy("conv_id", "position").collect()
    assert [tuple(r) for r in made] == [(1, 0, "K", "user", "b."), (1, 1, "R", "assistant", "c.")]


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_blocks_equal_search(size):
    """Every short sequence of rows, and long random ones, for every block size."""
    tables = repair.BlockTables(size=size)
    initials, faults = ["s", "u", "a", "t"], [None, "blank", "duplicate", "truncated"]
    every = [(i, f) for i in initials for f in faults]
    rng = random.Random(size)
    cases = [list(x) for n in range(3) for x in product(range(16), repeat=n)]
    cases += [[rng.randrange(16) for _ in range(rng.randint(3, 60))] for _ in range(1500)]
    cases += [[rng.choice([0, 4, 4, 8, 8, 7, 11]) for _ in range(rng.randint(3, 60))] for _ in range(1500)]
    for case in cases:
        assert tables.repair(np.array(case, dtype=np.uint8)) == best(tuple(every[b] for b in case))


def test_a_long_conversation_is_dealt_and_put_together(spark, monkeypatch):
    """Fragments of one conversation in many tasks give the same report."""
    monkeypatch.setattr(repair, "_FRAGMENT", 7)
    rng = random.Random(3)
    rows = [
        (5, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", f"{t}."]))
        for t in range(300)
    ] + [(5, 10, "user", "twenty.")] * 20
    frame = spark.createDataFrame(rows, SCHEMA).repartition(8)
    pieces = repair._fragments(repair._marked(repair._rows(frame, None)))
    assert pieces.count() > 40
    made = repair.digested(frame, repair.reports(frame))
    found = made.collect()[0].asDict()
    rows = in_order(rows)
    want = expected(rows)
    assert {k: found[k] for k in want} == want


def test_rows_of_one_conversation_are_ranged(spark):
    rows = spark.range(40000).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "'a.' AS text")
    marked = repair._marked(repair._rows(rows, None))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = repair._fragments(marked).groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1
