"""Conversation structure repair: the cheapest edits that make a conversation well formed, by A*.

A conversation is well formed when its turns are an optional system turn and then pairs of user and
assistant, or nothing at all. The lattice has a node for each (rows read, state of that grammar);
keeping, re-roling and deleting read a row, inserting does not. The heuristic is the suffix sum of
what every path still pays: the deletion of each blank or repeated row and the charge of each
truncated one. Nodes are taken from the heap by (cost plus heuristic, audit), so the first path that
reaches a node is the cheapest, and of those the one whose audit is least.

A conversation is solved block by block: the search goes on from the few states that are open at the
end of a block, states that another one beats at any continuation are dropped, and rows on which all
open states agree are handed out at once. So memory holds a block, the rows that are not yet decided
and 16 bytes for each row (to know a repeated one), however long a conversation is. Its rows meet in
one task, in order, because the digest of its repaired text is one sequence; rows of other
conversations do not wait for it.

Defined results: a null conversation id is a conversation of its own; null turns come first; rows of
equal turns go by role, then by text; a null text is one blank; a role that starts with none of the
letters s, u and a is never kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import bounded_batches, column

WHITE = " \t\n\x0b\x0c\r"
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, CHARGE = 3, 4, 3, 3
#: Rows that are searched together.
BLOCK = 128
#: States: nothing yet, after system, after user, after a pair. What a turn of each letter leads to.
NOTHING, SYSTEM, USER, PAIR = range(4)
STEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIR, (PAIR, "u"): USER}
DONE = (NOTHING, PAIR)
NAMES = {"u": "user", "a": "assistant"}
OK, BLANK, TRUNCATED, DUPLICATE = 0, 1, 2, 3


def search(rows: list[tuple[str, int]], entries: dict[int, tuple[int, str, str]], last: bool) -> dict[int, tuple[int, str, str]]:
    """The best (cost, audit, path) of each state after ``rows`` (letter, fault), from those before.

    With ``last`` only the best of the states that may end a conversation. A path has a character
    for each edit: k kept, u or a re-roled, - deleted, U or A inserted.
    """
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        fault = rows[i][1]
        rest[i] = rest[i + 1] + (CHARGE if fault == TRUNCATED else DELETE if fault else 0)
    heap = [(cost + rest[0], audit, 0, state, path) for state, (cost, audit, path) in entries.items()]
    heapq.heapify(heap)
    closed, out = set(), {}
    while heap:
        key, audit, i, state, path = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == n and (not last or state in DONE):
            out[state] = (key, audit, path)
            if last or len(out) == 4:
                break
        steps = [(INSERT, "I", i, c, c.upper()) for c in "ua"]
        if i < n:
            letter, fault = rows[i]
            paid = rest[i] - rest[i + 1]
            steps.append((DELETE - paid, "D", i + 1, None, "-"))
            if fault in (OK, TRUNCATED):
                steps.append((0, "K", i + 1, letter, "k"))
                steps += [(REROLE, "R", i + 1, c, c) for c in "ua"]
        for more, edit, at, letter, mark in steps:
            to = state if letter is None else STEP.get((state, letter))
            if to is not None and (at, to) not in closed:
                heapq.heappush(heap, (key + more, audit + edit, at, to, path + mark))
    return out


def useful(states: dict[int, tuple[int, str, str]]) -> dict[int, tuple[int, str, str]]:
    """Without the states that another one beats whatever follows: it could go on alike at the price
    of an insertion, or of deleting the system turn that it cannot take. Equal costs stay."""
    cost = {s: c for s, (c, _, _) in states.items()}
    far = float("inf")
    user = min(cost.get(USER, far), cost.get(PAIR, far) + INSERT)
    pair = min(cost.get(PAIR, far), cost.get(USER, far) + INSERT)
    most = {NOTHING: pair + DELETE, SYSTEM: pair, USER: user, PAIR: pair}
    return {s: v for s, v in states.items() if v[0] <= most[s]}


class _Conversation:
    """Reads the rows of one conversation in order; ``said`` takes each (edit, role, text) of the result."""

    def __init__(self, said):
        self.said, self.seen, self.block, self.held = said, set(), [], []
        self.open = {NOTHING: (0, "", "")}
        self.audit: list[str] = []
        self.counts = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.letter = self.turn = self.first = None
        self.cost = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        letter = role[:1]
        if self.letter is not None and self.letter + letter not in ("su", "ua", "au"):
            self.illegal += 1
        self.letter = letter
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        digest = hashlib.blake2b(b"%d:" % len(role) + role.encode() + text.encode(), digest_size=16).digest()
        if fault != BLANK and digest in self.seen:
            fault = DUPLICATE
        self.seen.add(digest)
        self.counts[fault] += 1
        self.block.append((letter, fault))
        self.held.append((role, text))
        if len(self.block) > BLOCK:  # one row stays, so that the end is searched as the end
            left = self.block.pop()
            self.open = useful(search(self.block, self.open, False))
            self.block = [left]
            self._agree(len(os.path.commonprefix([path for _, _, path in self.open.values()])))

    def _agree(self, n: int) -> None:
        """Hands out the first ``n`` edits, which are the same on all open paths."""
        if not n:
            return
        _, audit, path = next(iter(self.open.values()))
        at = 0
        for edit, mark in zip(audit[:n], path[:n], strict=True):
            if edit == "I":
                self.said(edit, NAMES[mark.lower()], "")
                continue
            role, text = self.held[at]
            at += 1
            if edit != "D":
                self.said(edit, NAMES.get(mark, role), text)
        self.audit.append(audit[:n])
        del self.held[:at]
        self.open = {s: (c, a[n:], p[n:]) for s, (c, a, p) in self.open.items()}

    def end(self) -> None:
        self.open = search(self.block, self.open, True)
        ((self.cost, audit, _),) = self.open.values()
        self._agree(len(audit))

    @property
    def gaps(self) -> int:
        return 0 if self.first is None else self.turn - self.first + 1 - self.turns


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, there) after the damage that crc32(`conv_id:turn`) mod 20 gives: 0 the
    row is not there, 1 no text, 2 no .!?, 3 twice, 4 role user. Nulls count as one blank."""
    rows = df.select(column(conv_col).cast("bigint").alias("conv_id"), column(turn_col).cast("bigint").alias("turn"), F.coalesce(column(role_col), F.lit(" ")).alias("role"), F.coalesce(column(text_col), F.lit(" ")).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("code", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.col("code") != 0, F.when(F.col("code") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("there"))


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows with their own fault (blank, truncated), each conversation's together and in order."""
    bounded_batches(rows.sparkSession)
    core = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(core == "", BLANK).when(F.right(core, F.lit(1)).isin(".", "!", "?"), OK).otherwise(TRUNCATED)
    rows = rows.select("conv_id", "turn", "role", "text", "there", fault.alias("fault"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "there", "fault")), strict=True)


_NONE = object()
_AUDIT = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _audits(batches):
    held, now, talk, sha, before = [], _NONE, None, None, b""

    def said(edit, role, text):
        nonlocal before
        sha.update(before + role.encode() + b":" + text.encode())
        before = b"\n"

    def close():
        talk.end()
        held.append((now, talk.gaps, talk.counts[BLANK], talk.counts[DUPLICATE], talk.counts[TRUNCATED], talk.illegal, talk.cost, "".join(talk.audit), sha.hexdigest()))

    def flushed():
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _AUDIT, strict=True)], schema=_AUDIT)
        held.clear()
        return out

    for conv, turn, role, text, there, fault in _rows(batches):
        if talk is None or conv != now:
            if talk is not None:
                close()
                if len(held) >= 10_000:
                    yield flushed()
            now, talk, sha, before = conv, _Conversation(said), hashlib.sha256(), b""
        if there:
            talk.add(turn, role, text, fault)
    if talk is not None:
        close()
        yield flushed()


def _turns(batches):
    held, now, talk, place = [], _NONE, None, 0

    def said(edit, role, text):
        nonlocal place
        held.append((now, place, edit, role, text))
        place += 1

    def flushed():
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _TURNS, strict=True)], schema=_TURNS)
        held.clear()
        return out

    for conv, turn, role, text, there, fault in _rows(batches):
        if talk is None or conv != now:
            if talk is not None:
                talk.end()
            now, talk, place = conv, _Conversation(said), 0
        if there:
            talk.add(turn, role, text, fault)
        if len(held) >= 1000:
            yield flushed()
    if talk is not None:
        talk.end()
    if held:
        yield flushed()


def audits(rows: DataFrame) -> DataFrame:
    """A row for each conversation of (conv_id, turn, role, text, there): conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256. Rows that are not there only name their conversation."""
    return _sorted(rows).mapInArrow(_audits, "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired turns themselves: conv_id, place (from 0), edit (K, R or I), role, text."""
    return _sorted(rows).mapInArrow(_turns, "conv_id bigint, place bigint, edit string, role string, text string")
