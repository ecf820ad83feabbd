"""Repair of conversations that lost their structure: the cheapest edits that make the roles alternate.

A row is kept, given the role user or assistant, or deleted; empty rows may be inserted. Blank and repeated rows
must go, cut-off ones cost more when they stay. The edits' initials in order are the audit; of the cheapest
audits the least in ASCII order counts.

A dynamic program runs over the rows and the states of ``s?(ua)+``. Its audits are persistent: a node holds one
more letter than its parent, a rolling hash of all its letters and its ancestors 1, 2, 4, ... nodes up, so all
audits share their prefixes. Equal costs are settled by searching the longest common prefix down the ancestors'
hashes; the prefix found is then compared letter by letter up to the node both share, so a collision cannot decide.

Rows are dealt by range of (conversation, turn, role, text). A conversation of any length is cut into chunks; a
chunk gives its cheapest audits from every state to every state, and these are joined by the same program, one
node per chunk. Only the chunks' audits pass one task per conversation, and, for a digest, its text in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.common import SPACES, column, join_small
from tallyshelf.session import settle

CHUNK = 2048
KEEP, ROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3

# States: nothing yet, after the system row, after a user row, after an assistant row.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_KEPT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLES = {_USER: "user", _ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}

_PRIME, _BASE = (1 << 61) - 1, 1_000_003


class Node:
    """An audit: its parent's letters and then ``part``."""

    __slots__ = ("parent", "part", "depth", "length", "hash", "up", "note")

    def __init__(self, parent: Node | None, part: str, note: object = None):
        self.parent, self.part, self.note = parent, part, note
        h = 0 if parent is None else parent.hash
        for c in part:
            h = (h * _BASE + ord(c)) % _PRIME
        self.hash = h
        self.depth = 0 if parent is None else parent.depth + 1
        self.length = len(part) + (0 if parent is None else parent.length)
        up, k = [] if parent is None else [parent], 0
        while k < len(up) and k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1
        self.up = up


def _lifted(x: Node, depth: int) -> Node:
    while x.depth > depth:
        k = (x.depth - depth).bit_length() - 1
        x = x.up[k]
    return x


def _meeting(x: Node, y: Node, differ) -> tuple[Node, Node]:
    """The lowest ancestors at one depth that ``differ`` no longer tells apart."""
    depth = min(x.depth, y.depth)
    x, y = _lifted(x, depth), _lifted(y, depth)
    if not differ(x, y):
        return x, y
    for k in reversed(range(len(x.up))):
        if k < len(x.up) and differ(x.up[k], y.up[k]):
            x, y = x.up[k], y.up[k]
    return x.parent, y.parent


def _letters(x: Node, above: Node) -> str:
    """The letters of ``x`` beyond its ancestor ``above``."""
    parts = []
    while x is not above:
        parts.append(x.part)
        x = x.parent
    return "".join(reversed(parts))


def _unequal(x: Node, y: Node) -> bool:
    return x is not y and (x.hash != y.hash or x.length != y.length)


def less(x: Node, y: Node) -> bool:
    """Whether the audit ``x`` comes before ``y``; both share their root."""
    if x is y:
        return False
    a, b = _meeting(x, y, _unequal)
    shared, _ = _meeting(a, b, lambda p, q: p is not q)
    if _letters(a, shared) == _letters(b, shared):
        return _letters(x, a) < _letters(y, b)
    return _letters(x, shared) < _letters(y, shared)


Best = list[tuple[int, Node] | None]


def _offer(best: Best, state: int, cost: int, node: Node) -> None:
    old = best[state]
    if old is None or cost < old[0] or cost == old[0] and less(node, old[1]):
        best[state] = (cost, node)


def _inserted(best: Best) -> Best:
    """Rows inserted here; states are settled in order of cost, which an insertion raises."""
    left = {s for s in range(4) if best[s]}
    done = set()
    while left:
        s = min(left, key=lambda k: best[k][0])
        done.add(s)
        cost, node = best[s]
        if _NEXT[s] not in done:
            _offer(best, _NEXT[s], cost + INSERT, Node(node, "I"))
        left = {k for k in range(4) if best[k]} - done
    return best


def _row(best: Best, initial: str, fault: int) -> Best:
    """One more row, and what is inserted after it."""
    out: Best = [None] * 4
    more = CUT_OFF if fault == TRUNCATED else 0
    for s in range(4):
        if best[s] is None:
            continue
        cost, node = best[s]
        _offer(out, s, cost + DELETE, Node(node, "D"))
        if fault in (BLANK, DUPLICATE):
            continue
        if (s, initial) in _KEPT:
            _offer(out, _KEPT[s, initial], cost + KEEP + more, Node(node, "K"))
        _offer(out, _NEXT[s], cost + ROLE + more, Node(node, "R"))
    return _inserted(out)


class Chunk:
    """Rows of one conversation in order, and its cheapest audits from each entry state to each state."""

    def __init__(self, entries: range):
        root = Node(None, "")
        self.best: dict[int, Best] = {}
        for e in entries:
            start: Best = [None] * 4
            start[e] = (0, root)
            self.best[e] = _inserted(start)
        self.root, self.size = root, 0
        self.faults, self.illegal = [0, 0, 0, 0], 0
        self.first = self.last = None
        self.turns: list[int] = []  # least, most, distinct

    def add(self, turn: int | None, role: str, fault: int) -> None:
        initial = role[:1]
        for e in self.best:
            self.best[e] = _row(self.best[e], initial, fault)
        self.faults[fault] += 1
        if self.size:
            self.illegal += self.last + initial not in _LEGAL
        else:
            self.first = initial
        self.last = initial
        self.size += 1
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns[1:] = [turn, self.turns[2] + 1]

    def records(self, conv: int | None, chunk: int) -> Iterator[tuple]:
        yield conv, chunk, 1, 0, self.first, self.last, 0, [*self.faults[1:], self.illegal, *self.turns]
        for entry, best in self.best.items():
            for leave, found in enumerate(best):
                if found:
                    yield conv, chunk, 2, 0, None, _letters(found[1], self.root), 0, [entry, leave, found[0]]


# A row (kind 0), a chunk's counts (1) or one of its audits (2); what is decided for a chunk (3) and for a
# conversation (4); a conversation that must be in the result (5).
_ROW = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("pos", pa.int64()), ("role", pa.string()),
                  ("text", pa.string()), ("fault", pa.int32()), ("nums", pa.list_(pa.int64()))])
_ROW_SQL = "conv_id bigint, chunk bigint, kind int, pos bigint, role string, text string, fault int, nums array<bigint>"
_HELD = 1 << 22


def _batch(rows: list[tuple], schema: pa.Schema = _ROW) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            yield from zip(*(c.to_pylist() for c in batch.slice(k, 512).columns))


def _batches(records: Iterator[tuple], schema: pa.Schema = _ROW, text: int = 5) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for r in records:
        out.append(r)
        held += len(r[text] or "") + 200
        if held > _HELD:
            yield _batch(out, schema)
            out, held = [], 0
    if out:
        yield _batch(out, schema)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[tuple]:
        number = TaskContext.get().partitionId() << 32
        chunk, conv, before = None, None, None
        for conv_id, turn, role, text, fault, later in _rows(batches):
            new = chunk is None or conv_id != conv
            if chunk is not None and (new or chunk.size >= CHUNK):
                yield from chunk.records(conv, number)
                number += 1
            if new or chunk.size >= CHUNK:
                # The conversation of a partition's first rows may have begun in the partition before.
                chunk = Chunk(range(1) if new and chunk is not None else range(4))
                conv = conv_id
            row = (conv_id, turn, role, text)
            if fault != BLANK and (later or row == before):
                fault = DUPLICATE
            before = row
            yield conv_id, number, 0, chunk.size, role, text, fault, None
            chunk.add(turn, role, fault)
        if chunk is not None:
            yield from chunk.records(conv, number)

    yield from _batches(records())


class _Joined:
    """The chunks of one conversation so far."""

    def __init__(self):
        root = Node(None, "")
        self.best: Best = [(0, root), None, None, None]
        self.counts, self.turns, self.last = [0, 0, 0, 0], [], None

    def count(self, first: str, last: str, nums: list[int]) -> None:
        self.counts = [a + b for a, b in zip(self.counts, nums)]
        if self.last is not None:
            self.counts[3] += self.last + first not in _LEGAL
        self.last = last
        if len(nums) > 4:
            least, most, distinct = nums[4:]
            if self.turns:
                least, distinct = self.turns[0], self.turns[2] + distinct - (self.turns[1] == least)
            self.turns = [least, most, distinct]

    def add(self, chunk: int, audits: list[tuple]) -> None:
        out: Best = [None] * 4
        for entry, leave, cost, part in audits:
            if self.best[entry]:
                before, node = self.best[entry]
                _offer(out, leave, before + cost, Node(node, part, (chunk, entry)))
        self.best = out

    def records(self, conv: int | None) -> Iterator[tuple]:
        ends: Best = [None]
        for s in (_START, _ASSISTANT):
            if self.best[s]:
                _offer(ends, 0, *self.best[s])
        cost, node = ends[0]
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        yield conv, -1, 4, -1, None, None, 0, [gaps, *self.counts, cost]
        while node.parent is not None:
            chunk, entry = node.note
            yield conv, chunk, 3, -1, None, node.part, 0, [entry]
            node = node.parent


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[tuple]:
        conv, joined, chunk, audits = None, None, None, []
        for conv_id, number, kind, _, role, text, _, nums in _rows(batches):
            if joined is not None and (conv_id != conv or number != chunk):
                joined.add(chunk, audits)
                audits = []
            if joined is None or conv_id != conv:
                if joined is not None:
                    yield from joined.records(conv)
                conv, joined = conv_id, _Joined()
            chunk = number
            if kind == 1:
                joined.count(role, text, nums)
            else:
                audits.append((*nums, text))
        if joined is not None:
            joined.add(chunk, audits)
            yield from joined.records(conv)

    yield from _batches(records())


def plan(rows: DataFrame) -> DataFrame:
    """Rows of all conversations with their faults, and the edits decided on, as one settled table.

    ``rows`` has conv_id, turn, role and text and may have other columns. They go by turn, nulls first, then
    by role and text, so repeated rows stand side by side. A null role or text is one space, which is blank;
    a role that begins with other than s, u or a, or is empty, cannot be kept. A null conv_id is a
    conversation of its own. An empty table gives no row; texts of any length are read whole.
    """
    wanted = rows.select(
        column("conv_id").cast("bigint").alias("conv_id"), column("turn").cast("bigint").alias("turn"),
        F.coalesce(column("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(column("text").cast("string"), F.lit(" ")).alias("text"))
    end = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    fault = F.when(end == "", BLANK).when(end.isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    said = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"),
                           "role", "text"), 256)
    wanted = wanted.select("*", fault.alias("fault"), said.alias("said"), F.coalesce("turn", F.lit(-(1 << 63))).alias("at"))
    again = settle(wanted.groupBy("said").agg(F.min("at").alias("first"), F.max("at").alias("final")).filter("first < final").select(
        "said", "first"))
    marked = join_small(wanted, again, ["said"], "left", 200).select(
        "conv_id", "turn", "role", "text", "fault", F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("later"))
    dealt = marked.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(
        "conv_id", "turn", "role", "text")
    seen = settle(dealt.mapInArrow(_chunks, _ROW_SQL))
    decided = seen.filter("kind > 0").repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "kind").mapInArrow(_decide, _ROW_SQL)
    return seen.filter("kind = 0").unionAll(settle(decided))


def _edited(records: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of plan in order of (conv_id, chunk, pos): (conv, edit, chunk, nr, role, text) for each letter of
    the audits, the text None for what is deleted; other kinds of rows pass as (conv, kind, nums)."""
    state, at, audit, chunk, conv, nr = _START, 0, "", None, None, 0

    def letter(kept: tuple | None):
        nonlocal state, at, nr
        edit = audit[at]
        at += 1
        nr += 1
        role, text = kept or (None, "")
        if edit == "D":
            return conv, "D", chunk, nr, role, None
        state = _KEPT[state, role[:1]] if edit == "K" else _NEXT[state]
        return conv, edit, chunk, nr, role if edit == "K" else _ROLES[state], text

    for conv_id, number, kind, _, role, text, _, nums in records:
        if kind in (3, 4, 5):
            while at < len(audit):
                yield letter(None)
            audit, at, nr = "", 0, 0
            conv, chunk = conv_id, number
            if kind == 3:
                audit, state = text, nums[0]
            else:
                yield conv_id, kind, nums
            continue
        while audit[at] == "I":
            yield letter(None)
        yield letter((role, text))
    while at < len(audit):
        yield letter(None)


def repaired(planned: DataFrame) -> DataFrame:
    """The conversations after repair: rows (conv_id, chunk, nr, edit, role, text) in order of chunk and nr."""
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("nr", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
                        ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((c, k, n, e, r, t) for c, e, k, n, r, t in _edited(_rows(batches)) if t is not None), schema)

    return planned.filter("kind IN (0, 3)").repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "pos").mapInArrow(
        run, "conv_id bigint, chunk bigint, nr bigint, edit string, role string, text string")


_DIGEST = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                     ("audit", pa.string()), ("repaired_sha256", pa.string())])


def digests(planned: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """What was found and done in each conversation, and a hash of its repaired ``role:text`` lines.

    With ``conversations`` (conv_id) those without a row are there too, with zeros and the hash of nothing.
    """
    if conversations is not None:
        planned = planned.unionAll(conversations.select(column("conv_id").cast("bigint").alias("conv_id")).distinct().select(
            "conv_id", F.lit(-2).cast("bigint"), F.lit(5), F.lit(-1).cast("bigint"), F.lit(None).cast("string"), F.lit(None).cast("string"),
            F.lit(0), F.lit(None).cast("array<bigint>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            conv, numbers, letters, state, open_ = None, [0] * 6, [], None, False
            for found in _edited(_rows(batches)):
                if open_ and found[0] != conv:
                    yield conv, *numbers, "".join(letters), state.hexdigest()
                    open_ = False
                if not open_:
                    conv, numbers, letters, state, open_, begun = found[0], [0] * 6, [], hashlib.sha256(), True, False
                if len(found) == 3:
                    numbers = found[2] if found[1] == 4 else numbers
                    continue
                _, edit, _, _, role, text = found
                letters.append(edit)
                if text is not None:
                    state.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                    begun = True
            if open_:
                yield conv, *numbers, "".join(letters), state.hexdigest()

        yield from _batches(records(), _DIGEST, 7)

    return planned.filter("kind IN (0, 3, 4, 5)").repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "pos").mapInArrow(
        run, "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
             "audit string, repaired_sha256 string")
