"""The trie of shared beginnings of conversations, with totals of every subtree.

Conversations that begin with the same turns share the nodes of that beginning. Nodes
are found by a hash of their whole path, a running total along each conversation.
Subtree totals come from parallel tree contraction: every round takes away leaves (rake)
and every other node of the chains in which each has one child (compress), so a
chain takes rounds by the logarithm of its length. A node taken from a chain notes what
its subtree is worth beside that of its child; going back through the rounds, it gets
its total from the child's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from arrearly.llm.common import written
from arrearly.llm.running import MASK, running_totals

#: Conversations of one family (ids from a multiple of it on) share a beginning ...
FAMILY = 5
#: ... of so many turns, less one, at most.
TURNS = 9
#: Bytes of ids after which a fragment of a list is closed.
_FRAGMENT = 1 << 20

_KEY = ["depth", "k1", "k2"]


def ordered_turns(messages: DataFrame) -> DataFrame:
    """(conv, pos, a, b, bytes): every turn by its place from 1, its role and text as a hash of
    120 bits, and the UTF-8 bytes of the text.

    Turns are taken by ``turn`` (NULL first), those of one turn by role and hash. A
    NULL role or text is empty; rows without conv_id are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary"))

    def number(start: int) -> Column:
        return F.conv(F.substring(digest, start, 15), 16, 10).cast("long")

    rows = messages.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").isNotNull().alias("turn_known"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        role.alias("role"),
        number(1).alias("a"),
        number(17).alias("b"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.lit(1).cast("long").alias("one"),
    )
    order = ["turn_known", "turn", "role", "a", "b"]
    ranked = running_totals(rows, ["conv"], order, {"pos": "one"})
    return ranked.select("conv", "pos", "a", "b", "bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, own, pos, a, b, bytes): conversations that share the beginning of their family.

    Conversation c has the first h turns of the family's first conversation, c - c % 5
    (all if it has fewer, none if there is no such), and then its own turns after its
    first h; h is the crc32 of its decimal id modulo 9. Remainders are not negative.
    """

    def shared(conv: Column) -> Column:
        return F.crc32(conv.cast("string").cast("binary")) % TURNS

    conv = F.col("conv")
    heads = turns.where((F.col("pos") < TURNS) & (F.pmod(conv, F.lit(FAMILY)) == 0))
    family = turns.where("pos = 1").select(
        F.try_subtract(conv, F.pmod(conv, F.lit(FAMILY))).alias("head"),
        conv.alias("member"),
        shared(conv).alias("h"),
    )
    taken = heads.join(family, (conv == F.col("head")) & (F.col("pos") <= F.col("h"))).select(
        F.col("member").alias("conv"), F.lit(False).alias("own"), "pos", "a", "b", "bytes"
    )
    own = turns.where(F.col("pos") > shared(conv)).select(
        "conv", F.lit(True).alias("own"), "pos", "a", "b", "bytes"
    )
    return taken.unionByName(own)


def _digests(ends: DataFrame) -> DataFrame:
    """Per node, SHA-256 of the ids of ``ends`` (key, conv), ascending and comma-joined.

    Tasks with a range of the sorted rows write out long pieces of the lists; where a
    list is long, only its pieces meet, as a stream.
    """
    schema = "depth long, k1 long, k2 long, first long, ids binary"
    out = "depth long, k1 long, k2 long, ends binary"
    arrow, arrow_out = (to_arrow_schema(StructType.fromDDL(s)) for s in (schema, out))

    def batches(rows: Iterator[dict], to: pa.Schema) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in rows:
            held.append(row)
            if len(held) == 4096:
                yield pa.RecordBatch.from_pylist(held, schema=to)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=to)

    def key_of(row: dict) -> tuple:
        return tuple(row[c] for c in _KEY)

    def dicts(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            yield from batch.to_pylist()

    def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists() -> Iterator[dict]:
            for key, rows in groupby(dicts(it), key_of):
                first, held, size = None, [], 0
                for row in rows:
                    first = row["conv"] if first is None else first
                    held.append(str(row["conv"]))
                    size += len(held[-1]) + 1
                    if size >= _FRAGMENT:
                        yield dict(zip(_KEY, key), first=first, ids=",".join(held).encode())
                        first, held, size = None, [], 0
                if held:
                    yield dict(zip(_KEY, key), first=first, ids=",".join(held).encode())

        return batches(lists(), arrow)

    def digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashes() -> Iterator[dict]:
            for key, rows in groupby(dicts(it), key_of):
                digest, between = hashlib.sha256(), b""
                for row in rows:
                    digest.update(between + row["ids"])
                    between = b","
                yield dict(zip(_KEY, key), ends=digest.digest())

        return batches(hashes(), arrow_out)

    by = [*_KEY, "conv"]
    listed = ends.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(pieces, schema)
    return listed.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(digests, out)


def nodes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The trie, written: per node conv (its smallest member), depth, up (the parent's
    conv; NULL for the root), n_convs, own (bytes saved here) and ends (a SHA-256 or NULL).

    ``turns`` has (conv, own, pos, a, b, bytes) and ``conversations`` all ids as conv.
    Members are counted before they are shuffled, so a common beginning is no hot key; the
    join with parents, where one may have very many children, is left to adaptive splitting.
    """
    counted = running_totals(
        turns.withColumn("one", F.lit(1).cast("long")), ["conv"], ["own", "pos"], {"depth": "one"}
    )
    salted = counted.select(
        "conv",
        "depth",
        "bytes",
        F.xxhash64("a", "b", "depth").bitwiseAND(F.lit(MASK)).alias("x1"),
        F.xxhash64(F.lit("second"), "b", "depth", "a").bitwiseAND(F.lit(MASK)).alias("x2"),
    )
    paths = running_totals(salted, ["conv"], ["depth"], {"k1": "x1", "k2": "x2"})

    def less(k: str, x: str) -> Column:
        return (F.col(k) - F.col(x)).bitwiseAND(F.lit(MASK))

    zero = F.lit(0).cast("long")
    roots = conversations.select("conv", *(zero.alias(c) for c in [*_KEY, "bytes"]))
    on_paths = paths.select("conv", *_KEY, "bytes", less("k1", "x1").alias("p1"), less("k2", "x2").alias("p2"))
    members = on_paths.unionByName(roots, allowMissingColumns=True)
    found = members.groupBy(*_KEY).agg(
        F.count("*").alias("n_convs"),
        F.min("conv").alias("conv"),
        F.max("bytes").alias("bytes"),
        F.max("p1").alias("p1"),
        F.max("p2").alias("p2"),
    )
    ends = members.groupBy("conv").agg(F.max(F.struct(*_KEY)).alias("end")).select("end.*", "conv")
    found = written(found.join(_digests(ends), _KEY, "left"))
    parents = found.select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("up")
    )
    return written(
        found.join(parents, ["depth", "p1", "p2"], "left").select(
            "conv",
            "depth",
            "up",
            "n_convs",
            ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"),
            "ends",
        )
    )


# --- subtree totals by contraction -------------------------------------------

_ID = ["conv", "depth"]
_TAKEN_LEAF, _TAKEN_CHAIN, _STAYS = "leaf", "chain", "stays"


def _staged(table: DataFrame, bit: int) -> DataFrame:
    """``table`` with what this round does with every node.

    The round looks at one bit of the depths. A node with a present parent whose bit is 0
    is taken if it is a leaf, or if it has one child and its own bit is 1: so never a
    node and its child together, and on a whole chain every other node. A bit that all
    depths have as 0 takes all leaves.
    """

    def is_set(name: str) -> Column:
        return F.shiftright(name, bit).bitwiseAND(F.lit(1).cast("long")) == 1

    below = F.col("up").isNotNull() & ~is_set("up_depth")
    leaf = (F.col("kids") == 0) & (below | F.col("up").isNull())
    chain = (F.col("kids") == 1) & below & is_set("depth")
    stage = F.when(leaf, _TAKEN_LEAF).when(chain, _TAKEN_CHAIN).otherwise(_STAYS)
    return table.withColumn("stage", stage)


def _messages(before: DataFrame) -> DataFrame:
    """What the nodes taken in a round leave to their neighbours, summed up by neighbour.

    Each gives its totals to its parent. A leaf is struck from the parent's children, a
    chain node is replaced there by its child, and the child gets the parent. The children are
    kept as the exclusive-or of their ids, which is the id itself once one is left.
    """
    taken, none = before.where(F.col("stage") != _STAYS), F.lit(None).cast("long")
    chain = F.col("stage") == _TAKEN_CHAIN
    to_parent = taken.where("up IS NOT NULL").select(
        F.col("up").alias("conv"),
        F.col("up_depth").alias("depth"),
        "leaves",
        "saved",
        F.when(chain, 0).otherwise(-1).cast("long").alias("kids"),
        F.when(chain, F.col("conv").bitwiseXOR(F.col("kid"))).otherwise(F.col("conv")).alias("kid"),
        F.when(chain, F.col("depth").bitwiseXOR(F.col("kid_depth")))
        .otherwise(F.col("depth"))
        .alias("kid_depth"),
        none.alias("new_up"),
        none.alias("new_up_depth"),
    )
    nothing = F.lit(0).cast("long")
    to_child = taken.where(chain).select(
        F.col("kid").alias("conv"),
        F.col("kid_depth").alias("depth"),
        *(nothing.alias(c) for c in ("leaves", "saved", "kids", "kid", "kid_depth")),
        F.col("up").alias("new_up"),
        F.col("up_depth").alias("new_up_depth"),
    )
    return to_parent.unionByName(to_child).groupBy(*_ID).agg(
        *(F.sum(c).alias(f"d_{c}") for c in ("leaves", "saved", "kids")),
        *(F.bit_xor(c).alias(f"d_{c}") for c in ("kid", "kid_depth")),
        *(F.max(c).alias(c) for c in ("new_up", "new_up_depth")),
    )


def subtree_totals(tree: DataFrame) -> DataFrame:
    """``tree`` with n_children, and n_leaves and saved summed over every node's subtree.

    Every round is one join of the nodes left with the messages to them, written as a
    table; tables shrink as nodes go. All loops run over rounds; no rows reach the driver.
    """
    children = tree.where("up IS NOT NULL").groupBy(F.col("up").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"), F.bit_xor("conv").alias("kid"), F.bit_xor("depth").alias("kid_depth")
    )
    zero = F.lit(0).cast("long")
    n = F.coalesce("n_children", zero)
    start = tree.join(children, _ID, "left").select(
        *_ID, "up", (F.col("depth") - 1).alias("up_depth"), F.col("up").alias("parent"), "n_convs", "ends",
        n.alias("n_children"), n.alias("kids"), "kid", "kid_depth",
        F.when(n == 0, 1).otherwise(0).cast("long").alias("leaves"), F.col("own").alias("saved"),
    )
    # One bit after another, then one beyond all depths.
    bits = int(tree.agg(F.max("depth")).first()[0] or 0).bit_length() + 1
    rounds = [written(_staged(start, 0))]
    while not rounds[-1].where(F.col("stage") != _TAKEN_LEAF).isEmpty():
        before = rounds[-1]
        left = before.where(F.col("stage") == _STAYS).drop("stage")
        told = left.join(_messages(before), _ID, "left")
        after = {c: F.col(c) + F.coalesce(f"d_{c}", zero) for c in ("leaves", "saved", "kids")}
        after |= {c: F.col(c).bitwiseXOR(F.coalesce(f"d_{c}", zero)) for c in ("kid", "kid_depth")}
        after |= {c: F.coalesce(f"new_{c}", c) for c in ("up", "up_depth")}
        rounds.append(written(_staged(told.withColumns(after).select(*left.columns), len(rounds) % bits)))
    # Back again: a chain node's child was taken later, so its totals are known.
    payload = [*_ID, "parent", "n_convs", "n_children", "ends", "leaves", "saved"]
    known: list[DataFrame] = []
    for table in reversed(rounds):
        taken = table.where(F.col("stage") == _TAKEN_CHAIN)
        if known and not taken.isEmpty():
            child = reduce(DataFrame.unionByName, known).select(
                F.col("conv").alias("kid"), F.col("depth").alias("kid_depth"),
                F.col("leaves").alias("kid_leaves"), F.col("saved").alias("kid_saved"),
            )
            whole = taken.join(child, ["kid", "kid_depth"]).withColumns(
                {c: F.col(c) + F.col(f"kid_{c}") for c in ("leaves", "saved")}
            )
            known.append(written(whole.select(*payload)))
        known.append(table.where(F.col("stage") == _TAKEN_LEAF).select(*payload))
    return reduce(DataFrame.unionByName, known)


def prefix_trie(messages: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations, all columns as longs but the last.

    ``messages`` has conv_id, turn, role and text; other columns are not read. A node is a
    beginning of ``depth`` turns that some conversations share, equal in role and text;
    the root is the empty one, and every conversation is its member. Columns: conv_id (the
    smallest member), depth, parent_conv_id (of the parent; NULL for the root), n_convs,
    n_children, n_leaves (nodes without children in the subtree), saved_tokens (over the
    subtree, (n_convs - 1) times the bytes of the node's last text), and ends_sha256, of the
    ids of the members that end here.

    NULL roles and texts are empty, NULL turns come first, repeated rows are turns of
    their own, rows without conv_id are left out; a table without conversations has no
    nodes. No task holds more than a batch of rows.
    """
    turns = ordered_turns(messages)
    tree = nodes(rebuilt(turns), turns.where("pos = 1").select("conv"))
    nobody = hashlib.sha256(b"").hexdigest()
    return subtree_totals(tree).select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce(F.lower(F.hex("ends")), F.lit(nobody)).alias("ends_sha256"),
    )
