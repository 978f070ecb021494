"""Repair of the turn structure of conversations, at the least cost.

A conversation is in order when the first letters of its roles read ``(s?(ua)+)?``. A
row may be kept, given the role user or assistant, or deleted, and an empty row of user
or assistant inserted anywhere; the cheapest edits win, of equals the ones whose
letters (D, I, K, R) come first in the alphabet.

The costs of finishing from each of the four states of that pattern form a vector, and
less one of them it can take only a few dozen values, whatever the conversation. So the
step over every possible block of rows is computed beforehand, from every such vector
(the method of the Four Russians): a conversation is read from its last block to its
first, one lookup a block. Then every block is expanded, with the vector at its end known,
and traced forward, where the first letter that keeps the least cost is always right.

Rows are ordered, compared and reduced to one byte each in tasks that share out a long
conversation; only these bytes meet in one task, which returns one letter or more for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from arrearly.llm.common import SPACES, written

# States: nothing yet, after a system row, after a user row, after an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Where a user or assistant row leads that may stand next, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
NEXT_ROLE = ("user", "user", "assistant", "user")
#: Per initial (s, u, a, any other): the states in which it may stand, and where it leads.
MAY_STAND = ((NOTHING,), (NOTHING, SYSTEM, ASSISTANT), (USER,), ())
LEADS_TO = (SYSTEM, USER, ASSISTANT, None)
#: A row's byte is 4 * initial + fault.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
_LEGAL_PAIRS = np.isin(np.arange(16), [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])
#: Bytes of rows after which a fragment of a conversation is closed.
_FRAGMENT = 1 << 20


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5  # of a row that stays


Vector = tuple[int, int, int, int]


@dataclass
class BlockTables:
    """Steps of the cost vector over single rows and over all blocks of ``size`` rows.

    A row is one of nine symbols: one that has to go, or an initial of four, sound
    or truncated.
    """

    costs: Costs = Costs()
    size: int = 4
    _traces: dict[tuple[bytes, int, int], tuple[str, int]] = field(default_factory=dict)

    #: The symbol of every byte of a row.
    SYMBOL = np.array(
        [0 if b % 4 in (BLANK, DUPLICATE) else 1 + b // 4 + 4 * (b % 4 == TRUNCATED) for b in range(16)],
        dtype=np.uint8,
    )

    def __post_init__(self) -> None:
        i = self.costs.insert
        self.vectors: list[Vector] = [(0, 2 * i, i, 0)]  # nothing left to read
        number = {self.vectors[0]: 0}
        steps, adds = [], []
        for vector in self.vectors:  # grows as new ones are met
            steps.append([])
            adds.append([])
            for symbol in range(9):
                v = self.before(vector, symbol)
                normal = tuple(x - v[ASSISTANT] for x in v)
                if normal not in number:
                    number[normal] = len(self.vectors)
                    self.vectors.append(normal)
                steps[-1].append(number[normal])
                adds[-1].append(v[ASSISTANT])
        self.step, self.add = np.array(steps), np.array(adds)
        symbols = np.arange(9)[None, :, None]
        block_step, block_add = self.step, self.add
        for _ in range(self.size - 1):
            # A block is read from its end: the rows after its first one come first.
            at = block_step[:, None, :]
            block_add = (block_add[:, None, :] + self.add[at, symbols]).reshape(len(steps), -1)
            block_step = self.step[at, symbols].reshape(len(steps), -1)
        self.block_step, self.block_add = block_step, block_add
        self._powers = 9 ** np.arange(self.size - 1, -1, -1)

    def before(self, after: Vector, symbol: int) -> Vector:
        """The costs of finishing before a row, from those after it."""
        c = self.costs
        row = [c.delete + x for x in after]
        if symbol:
            initial, extra = (symbol - 1) % 4, c.truncated * (symbol > 4)
            for q in range(4):
                row[q] = min(row[q], c.rerole + extra + after[NEXT[q]])
                if q in MAY_STAND[initial]:
                    row[q] = min(row[q], extra + after[LEADS_TO[initial]])
        user = min(row[USER], c.insert + row[ASSISTANT])
        assistant = min(row[ASSISTANT], c.insert + row[USER])
        return (
            min(row[NOTHING], c.insert + user), min(row[SYSTEM], c.insert + user), user, assistant
        )

    def trace(self, block: bytes, end: int, state: int) -> tuple[str, int]:
        """The letters for a block of symbols and the state behind it, given the number of
        the vector at its end and the state before it."""
        key = (block, end, state)
        if key not in self._traces:
            costs = [self.vectors[end]]
            for symbol in reversed(block):
                costs.append(self.before(costs[-1], symbol))
            costs.reverse()
            letters, q = "", state
            for symbol, here, after in zip(block, costs, costs[1:]):
                while True:
                    if here[q] == self.costs.delete + after[q]:
                        letters += "D"
                    elif here[q] == self.costs.insert + here[NEXT[q]]:
                        letters += "I"
                        q = NEXT[q]
                        continue
                    else:
                        initial, extra = (symbol - 1) % 4, self.costs.truncated * (symbol > 4)
                        if q in MAY_STAND[initial] and here[q] == extra + after[LEADS_TO[initial]]:
                            letters += "K"
                            q = LEADS_TO[initial]
                        else:
                            letters += "R"
                            q = NEXT[q]
                    break
            self._traces[key] = letters, q
        return self._traces[key]

    def repair(self, rows: np.ndarray) -> tuple[int, str]:
        """The least cost for the bytes of a conversation's rows, and the edits' letters."""
        symbols = self.SYMBOL[rows]
        head = len(rows) % self.size  # rows before the first whole block
        blocks = symbols[head:].reshape(-1, self.size)
        codes = blocks @ self._powers
        ends = np.empty(len(codes), dtype=np.uint16)
        v = cost = 0
        for k in range(len(codes) - 1, -1, -1):
            ends[k] = v
            cost += int(self.block_add[v, codes[k]])
            v = int(self.block_step[v, codes[k]])
        head_end = v
        for symbol in symbols[:head][::-1].tolist():
            cost += int(self.add[v, symbol])
            v = int(self.step[v, symbol])
        letters, q = self.trace(symbols[:head].tobytes(), head_end, NOTHING)
        audit = [letters]
        raw = blocks.tobytes()
        for k, end in enumerate(ends.tolist()):
            letters, q = self.trace(raw[k * self.size : (k + 1) * self.size], end, q)
            audit.append(letters)
        audit.append("I" * (0, 2, 1, 0)[q])
        return cost + self.vectors[v][NOTHING], "".join(audit)


# --- rows as bytes -----------------------------------------------------------

_CONVERSATION = ["conv_known", "conv"]
_PLACE = ["turn_known", "turn", "role", "digest"]


def _rows(messages: DataFrame, times: str | None) -> DataFrame:
    """Rows in canonical columns; keys are not NULL, so that equal ones can be joined."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    return messages.select(
        F.col("conv_id").isNotNull().alias("conv_known"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("turn_known"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text.alias("text"),
        (F.col(times).cast("long") if times else F.lit(1).cast("long")).alias("times"),
    )


def _marked(rows: DataFrame) -> DataFrame:
    """One row per distinct row of a conversation: how often it stands there, its byte
    where it stands first, and where it stands again.

    Repeated rows are counted before they are shuffled. Where a text was seen first is
    an aggregate as well; its key with the turn is unique on both sides of the join, so a
    text that fills a conversation is not joined in one place.
    """
    stripped = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.left("role", F.lit(1))
    kind = (
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    )
    fault = (
        F.when(stripped == "", BLANK)
        .when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
        .otherwise(SOUND)
    )
    distinct = (
        rows.select(*_CONVERSATION, *_PLACE, "times", (4 * kind + fault).alias("byte"))
        .groupBy(*_CONVERSATION, *_PLACE)
        .agg(F.sum("times").alias("times"), F.max("byte").alias("byte"))
    )
    seen = (
        distinct.where("times > 0")
        .groupBy(*_CONVERSATION, "role", "digest")
        .agg(F.min(F.struct("turn_known", "turn")).alias("first"))
        .select(*_CONVERSATION, "first.*", "role", "digest", F.lit(True).alias("is_first"))
    )
    b, blank = F.col("byte"), F.col("byte") % 4 == BLANK
    again = F.when(blank, b).otherwise(b - b % 4 + DUPLICATE)
    return distinct.join(seen, [*_CONVERSATION, *_PLACE], "left").select(
        *_CONVERSATION,
        *_PLACE,
        "times",
        F.when(F.col("is_first"), b).otherwise(again).cast("int").alias("first_byte"),
        again.cast("int").alias("next_byte"),
    )


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


_FRAGMENTS = (
    "conv_known boolean, conv long, turn_known boolean, turn long, role string, digest binary, "
    "part long, rows binary, first_turn long, last_turn long, n_turns long"
)


def _fragments(marked: DataFrame) -> DataFrame:
    """Conversations as runs of bytes, in pieces: a task has a range of the sorted rows,
    so a long conversation is dealt to many."""
    keys = [*_CONVERSATION, *_PLACE]
    arrow = to_arrow_schema(StructType.fromDDL(_FRAGMENTS))

    def runs(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            if not batch.num_rows:
                continue
            known, conv, turn_known, turn, times = (
                _column(batch, c) for c in ("conv_known", "conv", "turn_known", "turn", "times")
            )
            new = np.flatnonzero((known[1:] != known[:-1]) | (conv[1:] != conv[:-1])) + 1
            first, following = (_column(batch, c).astype(np.uint8) for c in ("first_byte", "next_byte"))
            at = 0
            edges = [0, *new.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                # Rows that stand very often fill fragments of their own.
                while a < b:
                    n = max(1, int(np.searchsorted(np.cumsum(times[a:b]), _FRAGMENT, side="right")))
                    there = times[a : a + n]
                    place = {c: batch.column(c)[a].as_py() for c in _PLACE}
                    group = {"conv_known": bool(known[a]), "conv": int(conv[a])} | place
                    turns = turn[a : a + n][turn_known[a : a + n] & (there > 0)]
                    ends = {
                        "first_turn": int(turns[0]) if len(turns) else None,
                        "last_turn": int(turns[-1]) if len(turns) else None,
                        "n_turns": int((np.diff(turns) != 0).sum() + 1) if len(turns) else 0,
                    }
                    if n == 1 and there[0] > _FRAGMENT:
                        head, left = bytes([first[a]]), int(there[0])
                        while left:
                            size = min(left, _FRAGMENT)
                            rows = head + bytes([following[a]]) * (size - len(head))
                            yield group | ends | {"part": at, "rows": rows}
                            ends = ends | {"n_turns": len(turns)}
                            head, left, at = b"", left - size, at + 1
                    else:
                        rows = np.repeat(following[a : a + n], there)
                        starts = (np.cumsum(there) - there)[there > 0]
                        rows[starts] = first[a : a + n][there > 0]
                        yield group | ends | {"part": at, "rows": rows.tobytes()}
                        at += 1
                    a += n

    def made(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(runs(it), 4096):
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    ordered = marked.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(made, _FRAGMENTS)


def _chunks(items: Iterable, size: int) -> Iterator[list]:
    held = []
    for x in items:
        held.append(x)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _dicts(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    return chain.from_iterable(batch.to_pylist() for batch in it)


def _conversation(row: dict) -> tuple[bool, int]:
    return row["conv_known"], row["conv"]


_REPORT = (
    "conv_known boolean, conv long, gaps long, blank long, duplicate long, truncated long, "
    "illegal long, cost long, audit string"
)


def _reports(fragments: DataFrame, costs: Costs) -> DataFrame:
    """One row per conversation from its bytes."""
    arrow = to_arrow_schema(StructType.fromDDL(_REPORT))

    def report(key: tuple[bool, int], parts: list[dict], tables: BlockTables) -> dict:
        rows = np.frombuffer(b"".join(p["rows"] for p in parts), dtype=np.uint8)
        faults = np.bincount(rows % 4, minlength=4)
        pairs = 4 * (rows[:-1] // 4) + rows[1:] // 4
        cost, audit = tables.repair(rows)
        turned = [p for p in parts if p["n_turns"]]
        gaps = 0
        if turned:
            shared = sum(p["last_turn"] == q["first_turn"] for p, q in zip(turned, turned[1:]))
            distinct = sum(p["n_turns"] for p in turned) - shared
            gaps = turned[-1]["last_turn"] - turned[0]["first_turn"] + 1 - distinct
        return dict(
            conv_known=key[0], conv=key[1], gaps=gaps, blank=int(faults[BLANK]),
            duplicate=int(faults[DUPLICATE]), truncated=int(faults[TRUNCATED]),
            illegal=int((~_LEGAL_PAIRS[pairs]).sum()), cost=cost, audit=audit,
        )

    def made(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = BlockTables(costs)
        reports = (report(k, list(g), tables) for k, g in groupby(_dicts(it), _conversation))
        for rows in _chunks(reports, 1024):
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return (
        fragments.repartition(*_CONVERSATION)
        .sortWithinPartitions(*_CONVERSATION, *_PLACE, "part")
        .mapInArrow(made, _REPORT)
    )


# --- repaired conversations --------------------------------------------------

_REPORTED = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _edited(rows: Iterator[dict], audit: str) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of every row that stays or is inserted."""
    q, letters = NOTHING, iter(audit)
    for row in rows:
        for _ in range(row["times"]):
            while (letter := next(letters)) == "I":
                yield letter, NEXT_ROLE[q], ""
                q = NEXT[q]
            if letter == "K":
                yield letter, row["role"], row["text"]
                q = LEADS_TO["sua".index(row["role"][0])]
            elif letter == "R":
                yield letter, NEXT_ROLE[q], row["text"]
                q = NEXT[q]
    for letter in letters:
        yield letter, NEXT_ROLE[q], ""
        q = NEXT[q]


Repaired = tuple[dict, Iterator[tuple[str, str, str]]]


def _streamed(
    messages: DataFrame,
    reports: DataFrame,
    times: str | None,
    schema: str,
    emit: Callable[[Iterator[Repaired]], Iterator[dict]],
) -> DataFrame:
    """``emit`` over all conversations, each a report and its repaired rows in order.

    Rows follow the report of their conversation in one sorted stream, so a task holds
    a report and a batch of rows, however long the conversation.
    """
    rows = _rows(messages, times).where("times > 0").withColumn("is_row", F.lit(True))
    heads = reports.select(
        *_CONVERSATION, F.lit(False).alias("is_row"), F.struct(*_REPORTED).alias("report")
    )
    both = heads.unionByName(rows, allowMissingColumns=True)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def conversations(it: Iterator[pa.RecordBatch]) -> Iterator[Repaired]:
        for (known, conv), group in groupby(_dicts(it), _conversation):
            report = {"conv_id": conv if known else None} | next(group)["report"]
            yield report, _edited(group, report["audit"])

    def made(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(emit(conversations(it)), 1024):
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    order = [*_CONVERSATION, "is_row", *_PLACE]
    ordered = both.repartition(*_CONVERSATION).sortWithinPartitions(*order)
    return ordered.select(*_CONVERSATION, "times", "role", "text", "report").mapInArrow(made, schema)


def reports(messages: DataFrame, costs: Costs = Costs(), times: str | None = None) -> DataFrame:
    """Per conversation, ``conv_id``, its faults and the cheapest repair, as a written table.

    ``messages`` has conv_id, turn, role and text; other columns are not read. Rows are
    taken by turn (NULL first), rows of one turn by role and the SHA-256 of the text.
    ``times`` names a column that says how often a row stands there: 0 leaves it out but
    keeps its conversation. A NULL role or text is one space; NULL conv_ids are one
    conversation; a role without letters has no legal initial. ``gaps`` counts turns that
    are missing between the first and the last; ``blank``, ``duplicate`` and ``truncated``
    rows are counted by their first fault; ``illegal`` pairs of neighbours may not follow
    each other. A conversation without rows has zeros and an empty ``audit``; an empty
    table has no conversations. A task holds a byte and about two letters for every row
    of one conversation, as its ``audit`` does.
    """
    made = _reports(_fragments(_marked(_rows(messages, times))), costs)
    return written(made)


def repaired(messages: DataFrame, made: DataFrame, times: str | None = None) -> DataFrame:
    """The repaired rows: (conv_id, position, edit, role, text), position from 0.

    ``made`` comes from ``reports`` with the same arguments. Deleted rows are gone, an
    inserted row has an empty text.
    """

    def emit(conversations: Iterator[Repaired]) -> Iterator[dict]:
        for report, rows in conversations:
            for i, (edit, role, text) in enumerate(rows):
                yield dict(conv_id=report["conv_id"], position=i, edit=edit, role=role, text=text)

    schema = "conv_id long, position long, edit string, role string, text string"
    return _streamed(messages, made, times, schema, emit)


def digested(messages: DataFrame, made: DataFrame, times: str | None = None) -> DataFrame:
    """The reports with ``repaired_sha256``: SHA-256 of the repaired rows as ``role:text``,
    joined by line breaks. It can only be taken in order, so the rows of a conversation
    pass one task, as a stream."""

    def emit(conversations: Iterator[Repaired]) -> Iterator[dict]:
        for report, rows in conversations:
            digest, between = hashlib.sha256(), b""
            for _, role, text in rows:
                digest.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                between = b"\n"
            yield report | {"repaired_sha256": digest.hexdigest()}

    counts = ", ".join(f"{c} long" for c in _REPORTED[:-1])
    schema = f"conv_id long, {counts}, audit string, repaired_sha256 string"
    return _streamed(messages, made, times, schema, emit)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by the crc32 of ``conv_id:turn`` modulo 20: 0 drops
    a row (``times`` is 0), 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes
    it the user's. NULLs become one space (but for the turn's place)."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    k = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = shown("text")
    return conversations.select(
        "conv_id",
        "turn",
        F.when(k == 4, "user").otherwise(shown("role")).alias("role"),
        F.when(k == 1, "")
        .when(k == 2, F.translate(text, ".!?", ""))
        .otherwise(text)
        .alias("text"),
        F.when(k == 0, 0).when(k == 3, 2).otherwise(1).cast("long").alias("times"),
    )
