"""Conversation structure repair: the cheapest edits that make roles alternate, by a time-major tensor DP.

Rows are sorted into partitions by range of (conv_id, turn). A task reads its conversations in order, buckets
those that lie in it whole by length, and walks each bucket backwards turn by turn: one numpy step updates the costs of
all four states of all conversations, (turn, conversation, state), and every step is kept. A walk forwards
then chooses each conversation's edits, again one turn of all conversations at a time.

A conversation that reaches over a partition's end, or is longer than a task should hold, is cut into pieces
of at most PIECE_TURNS turns. The same DP gives the (min, +) matrix of a piece; matrices of a
conversation are multiplied from its end, so each piece knows the costs behind it; it is then traced from each
state, and the states are joined from the start. So no task holds the turns of a long conversation.

States: 0 nothing yet, 1 after the system turn, 2 after a user's, 3 after an assistant's. 0 and 3 may end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import crc32_sql, parallelism, written

#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns and characters of a piece; turns and characters that a task holds before it repairs them.
PIECE_TURNS, PIECE_CHARS = 4096, 4 << 20
HELD_TURNS, HELD_CHARS = 16_384, 8 << 20

_INITIALS = {"s": 0, "u": 1, "a": 2}
_OTHER = 3
#: State after an inserted or re-roled turn: a user's, but after a user's an assistant's.
_TURNED = np.array([2, 2, 3, 2])
#: State after a kept turn, by its role and the state before; 4: not allowed.
_KEPT = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
_FAR = np.int64(1) << 40
#: Costs at the end of a conversation: a started pair is filled by insertions.
_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
_LEGAL = {"su", "ua", "au"}
_WHITE = " \t\n\x0b\x0c\r"
_NONE, _BLANK, _DUPLICATE, _CUT = range(4)
_SET_ROLE = {2: "user", 3: "assistant"}

SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows of a conversation table with planted faults, one in 20 each by the
    checksum of `conv_id:turn`: dropped (a row that is gone still names its conversation), emptied, without `.!?`,
    repeated, role set to user. Null roles and texts, and nulls in the checksum, count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.expr("explode(IF(fault = 3, array(0, 1), array(0)))")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), times.alias("copy")).drop("copy")


def _steps(after: np.ndarray, kinds: np.ndarray, faults: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of deleting, keeping and re-roling one turn of all conversations, by the state before; after: (n, 4)."""
    cut = np.where(faults == _CUT, TRUNCATED, 0)[:, None]
    cut = np.where(((faults == _BLANK) | (faults == _DUPLICATE))[:, None], _FAR, cut)
    beyond = np.concatenate([after, np.full((len(after), 1), _FAR)], axis=1)
    return after + DELETE, np.take_along_axis(beyond, _KEPT[kinds], axis=1) + cut, after[:, _TURNED] + REROLE + cut


def backward(kinds: np.ndarray, faults: np.ndarray, lengths: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least costs from each turn on, (turns + 1, n, 4), of n conversations; kinds and faults: (turns, n); end: (n, 4)."""
    costs = np.empty((len(kinds) + 1, *end.shape), np.int64)
    costs[-1] = end
    for t in range(len(kinds) - 1, -1, -1):
        best = np.minimum.reduce(_steps(costs[t + 1], kinds[t], faults[t]))
        user, assistant = best[:, 2].copy(), best[:, 3].copy()
        best[:, 2] = np.minimum(user, assistant + INSERT)
        best[:, 3] = np.minimum(assistant, user + INSERT)
        best[:, :2] = np.minimum(best[:, :2], best[:, 2:3] + INSERT)
        costs[t] = np.where((t < lengths)[:, None], best, costs[t + 1])
    return costs


def forward(costs: np.ndarray, kinds: np.ndarray, faults: np.ndarray, lengths: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits and states after them: of the cheapest edits those whose letters come first. letters: (3 * turns, n), two
    places for insertions before each turn, 0 where nothing is done."""
    n = len(lengths)
    letters = np.zeros((3 * len(kinds), n), np.uint8)
    states, row = states.copy(), np.arange(n)
    for t in range(len(kinds)):
        delete, keep, rerole = _steps(costs[t + 1], kinds[t], faults[t])
        todo = t < lengths
        for place in range(3):
            best = costs[t][row, states]
            choice = np.select(
                [delete[row, states] == best, costs[t][row, _TURNED[states]] + INSERT == best, keep[row, states] == best],
                [ord("D"), ord("I"), ord("K")],
                ord("R"),
            )
            letters[3 * t + place] = np.where(todo, choice, 0)
            kept = np.where(choice == ord("K"), _KEPT[kinds[t], states], _TURNED[states])
            states = np.where(todo & (choice != ord("D")), kept, states)
            todo &= choice == ord("I")
    return letters, states


def _audits(letters: np.ndarray) -> list[str]:
    return [c.tobytes().replace(b"\0", b"").decode() for c in np.ascontiguousarray(letters.T)]


def _closing(state: int) -> str:
    return "I" * (int(_END[state]) // INSERT)


def edited(audit: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The turns that the edits leave, from a state on."""
    out, at = [], 0
    for edit in audit:
        if edit == "K":
            state = int(_KEPT[_INITIALS[roles[at][:1]], state])
            out.append((roles[at], texts[at]))
        elif edit != "D":
            state = int(_TURNED[state])
            out.append((_SET_ROLE[state], texts[at] if edit == "R" else ""))
        at += edit != "I"
    return out


class Talk:
    """Turns of one conversation, or of a piece of it, in order."""

    def __init__(self, conv_id: object):
        self.conv_id, self.turns, self.roles, self.texts, self.chars = conv_id, [], [], [], 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def faults(self) -> list[int]:
        """The first fault of each turn, duplicates of turns in here only."""
        seen, out = set(), []
        for turn in zip(self.roles, self.texts, strict=True):
            seen_text = turn[1].rstrip(_WHITE)
            out.append(_BLANK if not seen_text else _DUPLICATE if turn in seen else _NONE if seen_text[-1] in ".!?" else _CUT)
            seen.add(turn)
        return out

    def digests(self, faults: list[int]) -> list[bytes | None]:
        """Of turns that an earlier piece may hold too: a hash of conversation, role and text."""
        one = lambda r, t: hashlib.sha256(repr((self.conv_id, r)).encode() + b"\0" + t.encode()).digest()
        return [one(r, t) if f in (_NONE, _CUT) else None for r, t, f in zip(self.roles, self.texts, faults, strict=True)]


def _illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in _LEGAL for a, b in zip(roles, roles[1:], strict=False))


def _tensor(roles: list[list[str]], faults: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kinds and faults, time-major, and lengths."""
    lengths = np.array([len(f) for f in faults])
    kinds, wrong = np.zeros((2, lengths.max(initial=0), len(faults)), np.int8)
    for j, (r, f) in enumerate(zip(roles, faults, strict=True)):
        kinds[: len(r), j] = [_INITIALS.get(x[:1], _OTHER) for x in r]
        wrong[: len(f), j] = f
    return kinds, wrong, lengths


def _buckets(sizes: list[int]) -> list[list[int]]:
    """Indices whose sizes have equal bit lengths."""
    out: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        out.setdefault(n.bit_length(), []).append(i)
    return list(out.values())


def repair_whole(talks: list[Talk]) -> list[tuple[list[int], str, list[tuple[str, str]]]]:
    """SUMMARY values, audit and repaired turns of each conversation."""
    faults = [t.faults() for t in talks]
    out: list = [None] * len(talks)
    for bucket in _buckets([len(f) for f in faults]):
        kinds, wrong, lengths = _tensor([talks[i].roles for i in bucket], [faults[i] for i in bucket])
        costs = backward(kinds, wrong, lengths, np.tile(_END, (len(bucket), 1)))
        letters, states = forward(costs, kinds, wrong, lengths, np.zeros(len(bucket), int))
        for j, (i, audit) in enumerate(zip(bucket, _audits(letters), strict=True)):
            t, f = talks[i], faults[i]
            audit += _closing(int(states[j]))
            known = {x for x in t.turns if x is not None}
            gaps = max(known) - min(known) + 1 - len(known) if known else 0
            out[i] = ([gaps, f.count(_BLANK), f.count(_DUPLICATE), f.count(_CUT), _illegal(t.roles), int(costs[0, j, 0])], audit, edited(audit, 0, t.roles, t.texts))
    return out


def _lines(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"{r}:{t}" for r, t in turns)


_TURNS = "array<struct<role:string,text:string>>"
_PIECE = "piece long, turns array<long>, roles array<string>, texts array<string>, faults array<int>, digests array<binary>"
_PIECE_ARROW = [("piece", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("faults", pa.list_(pa.int32())), ("digests", pa.list_(pa.binary()))]
_DONE = ", ".join(f"{c} long" for c in SUMMARY) + f", audit string, repaired_sha256 string, repaired {_TURNS}"
_DONE_ARROW = [*((c, pa.int64()) for c in SUMMARY), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _as_structs(turns: list[tuple[str, str]]) -> list[dict]:
    return [{"role": r, "text": t} for r, t in turns]


def _first_look(with_turns: bool, piece_turns: int):
    """Of sorted rows: repaired conversations, and the pieces of those that may reach over the partition's ends."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pieces, schema = TaskContext.get().partitionId() << 33, 0, None
        talk, split, held = None, True, []

        def piece() -> pa.RecordBatch:
            nonlocal pieces
            faults, pieces = talk.faults(), pieces + 1
            return _batch([(talk.conv_id, *[None] * len(_DONE_ARROW), part + pieces, talk.turns, talk.roles, talk.texts, faults, talk.digests(faults))], schema)

        def whole() -> pa.RecordBatch:
            rows = []
            for t, (numbers, audit, turns) in zip(held, repair_whole(held), strict=True):
                digest = hashlib.sha256(_lines(turns).encode()).hexdigest()
                rows.append((t.conv_id, *numbers, audit, digest, _as_structs(turns) if with_turns else None, *[None] * len(_PIECE_ARROW)))
            held.clear()
            return _batch(rows, schema)

        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), *_DONE_ARROW, *_PIECE_ARROW])
            for conv_id, turn, role, text, gone in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")), strict=True):
                if talk is None:
                    talk = Talk(conv_id)
                elif conv_id != talk.conv_id:
                    if split:
                        yield piece()
                    else:
                        held.append(talk)
                    talk, split = Talk(conv_id), False
                    if sum(len(t.turns) + 1 for t in held) >= HELD_TURNS or sum(t.chars for t in held) >= HELD_CHARS:
                        yield whole()
                if not gone:
                    talk.add(turn, role, text)
                    if len(talk.turns) >= piece_turns or talk.chars >= PIECE_CHARS:
                        yield piece()
                        talk, split = Talk(conv_id), True
        if held:
            yield whole()
        if talk is not None:
            yield piece()

    return rows_of


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces with again, the places of turns that an earlier piece holds: faults, and the least costs from each
    state before a piece to each one behind it, as 16 numbers."""
    for batch in batches:
        roles, faults = batch.column("roles").to_pylist(), batch.column("faults").to_pylist()
        for f, again in zip(faults, batch.column("again").to_pylist(), strict=True):
            for i in again or []:
                f[i] = _DUPLICATE
        found: list = [None] * len(roles)
        for bucket in _buckets([len(r) for r in roles]):
            kinds, wrong, lengths = _tensor([roles[i] for i in bucket], [faults[i] for i in bucket])
            ends = np.tile(np.where(np.eye(4, dtype=bool), 0, _FAR), (len(bucket), 1))
            first = backward(kinds.repeat(4, axis=1), wrong.repeat(4, axis=1), lengths.repeat(4), ends)[0]
            for j, i in enumerate(bucket):
                found[i] = first[4 * j : 4 * j + 4].T.ravel().tolist()
        yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(faults, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))], names=["piece", "marked", "matrix"])


def _ends(pieces: pa.Table) -> pa.Table:
    """Of the pieces of one conversation: the least costs behind each one."""
    ids, out, end = pieces.column("piece").to_pylist(), [], _END
    order = sorted(range(len(ids)), key=lambda i: -ids[i])
    matrices = pieces.column("matrix").to_pylist()
    for i in order:
        out.append(end.tolist())
        end = (np.array(matrices[i]).reshape(4, 4) + end).min(axis=1)
    return pa.table({"piece": pa.array([ids[i] for i in order], pa.int64()), "end": pa.array(out, pa.list_(pa.int64()))})


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces with end: edits and last state for each state before them, and the least costs from there."""
    for batch in batches:
        roles, faults, ends = (batch.column(c).to_pylist() for c in ("roles", "marked", "end"))
        exits, audits, costs = ([None] * len(roles) for _ in range(3))
        for bucket in _buckets([len(r) for r in roles]):
            kinds, wrong, lengths = (x.repeat(4, axis=-1) for x in _tensor([roles[i] for i in bucket], [faults[i] for i in bucket]))
            table = backward(kinds, wrong, lengths, np.array([ends[i] for i in bucket], np.int64).repeat(4, axis=0))
            letters, states = forward(table, kinds, wrong, lengths, np.tile(np.arange(4), len(bucket)))
            found = _audits(letters)
            for j, i in enumerate(bucket):
                exits[i], audits[i], costs[i] = states[4 * j : 4 * j + 4].tolist(), found[4 * j : 4 * j + 4], table[0, 4 * j].tolist()
        more = {"exits": pa.array(exits, pa.list_(pa.int64())), "audits": pa.array(audits, pa.list_(pa.string())), "costs": pa.array(costs, pa.list_(pa.int64()))}
        kept = {c: batch.column(c) for c in ("conv_id", "piece", "turns", "roles", "texts", "marked")}
        yield pa.RecordBatch.from_pydict(kept | more)


def _joining(with_turns: bool):
    """Of traced pieces, sorted by conversation and piece: the conversation's row. Texts go through the hash and are
    not held, but for with_turns."""

    class Whole:
        def __init__(self, conv_id: object, cost: int):
            self.conv_id, self.cost, self.state, self.hash, self.edits, self.turns = conv_id, cost, 0, hashlib.sha256(), [], []
            self.first, self.last, self.distinct, self.counts, self.illegal, self.role, self.begun = None, None, 0, [0] * 4, 0, None, False

        def add(self, piece: dict) -> None:
            known = sorted({t for t in piece["turns"] if t is not None})
            if known:
                self.distinct += len(known) - (known[0] == self.last)
                self.first, self.last = known[0] if self.first is None else self.first, known[-1]
            for f in piece["marked"]:
                self.counts[f] += 1
            self.illegal += _illegal([r for r in [self.role] if r is not None] + piece["roles"])
            self.role = piece["roles"][-1] if piece["roles"] else self.role
            self.extend(piece["audits"][self.state], piece["roles"], piece["texts"])
            self.state = piece["exits"][self.state]

        def extend(self, audit: str, roles: list[str], texts: list[str]) -> None:
            turns = edited(audit, self.state, roles, texts)
            if turns:
                self.hash.update(("\n" * self.begun + _lines(turns)).encode())
                self.begun = True
            self.edits.append(audit)
            if with_turns:
                self.turns += turns

        def row(self) -> tuple:
            self.extend(_closing(self.state), [], [])
            gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
            numbers = (gaps, self.counts[_BLANK], self.counts[_DUPLICATE], self.counts[_CUT], self.illegal, self.cost)
            return self.conv_id, *numbers, "".join(self.edits), self.hash.hexdigest(), _as_structs(self.turns) if with_turns else None

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk, schema = None, None
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), *_DONE_ARROW])
            for piece in batch.to_pylist():
                if talk is not None and talk.conv_id != piece["conv_id"]:
                    yield _batch([talk.row()], schema)
                    talk = None
                talk = talk or Whole(piece["conv_id"], piece["costs"][0])
                talk.add(piece)
        if talk is not None:
            yield _batch([talk.row()], schema)

    return rows_of


def repair(rows: DataFrame, with_turns: bool = False, piece_turns: int = PIECE_TURNS, parts: int | None = None) -> DataFrame:
    """One row per conv_id of rows (conv_id, turn, role, text and, if there is one, gone: the row only names its
    conversation): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 and, with_turns, repaired.

    Turns go by turn, nulls first, ties by role and text (beyond its first 64 characters by its hash). A turn's first fault counts: blank; duplicate of an
    earlier turn in role and text; truncated (doesn't end in .!?). A null role or text counts as one space, a null
    conv_id is a conversation. The edits (Keep, Rerole, Delete, Insert) are the cheapest that give `(s?(ua)+)?`,
    of equal ones the first by letters. A conversation without turns has zeros, no edits and the empty text's hash.
    Conversations and texts of any length; an empty table gives no rows; other columns are not carried.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
    turns = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), gone.alias("gone"))
    # a turn's rows may be spread over partitions, equal ones too
    order: list[Column | str] = ["conv_id", "turn", "role", "start", "mark", "tie"]
    turns = turns.withColumns({"start": F.substring("text", 1, 64), "mark": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    dealt = turns.repartitionByRange(parts or parallelism(rows.sparkSession), *order).sortWithinPartitions(*order).drop("start", "mark", "tie")
    seen = written(dealt.mapInArrow(_first_look(with_turns, piece_turns), f"conv_id {kind}, {_DONE}, {_PIECE}"), "talks")

    done = ["conv_id", *SUMMARY, "audit", "repaired_sha256", "repaired"]
    pieces = seen.where("piece IS NOT NULL").drop(*done[1:])
    each = pieces.select("piece", F.posexplode("digests").alias("at", "digest")).where("digest IS NOT NULL")
    first = each.groupBy("digest").agg(F.min("piece").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = each.join(first, "digest").where("piece > first").groupBy("piece").agg(F.collect_list("at").alias("again"))
    marked = pieces.drop("turns", "texts", "digests").join(again, "piece", "left").select("piece", "roles", "faults", "again")
    matrices = written(marked.mapInArrow(_matrices, "piece long, marked array<int>, matrix array<long>"), "talk-matrices", 16)
    ends = matrices.select("piece", "matrix").join(pieces.select("piece", "conv_id"), "piece").groupBy("conv_id").applyInArrow(_ends, "piece long, end array<long>")
    behind = pieces.drop("faults", "digests").join(matrices.drop("matrix"), "piece").join(ends, "piece")
    traced = behind.mapInArrow(_traces, f"conv_id {kind}, piece long, turns array<long>, roles array<string>, texts array<string>, marked array<int>, exits array<long>, audits array<string>, costs array<long>")
    order = ["conv_id", "piece"]
    whole = written(traced.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_joining(with_turns), f"conv_id {kind}, {_DONE}"), "talks-joined", 16)
    out = seen.where("piece IS NULL").select(*done).unionByName(whole.select(*done))
    return out if with_turns else out.drop("repaired")


def _oracle() -> str:
    """Least (cost, audit, repaired turns) by state, from the first turn on: equal costs in one state come from audits
    none of which begins another, so the least one stays so whatever follows."""
    step = lambda b, cost, edit, line="": f"{{'c': {b}.c + {cost}, 'a': {b}.a || '{edit}', 'o': {b}.o{line}}}"
    insert = lambda b, who: step(b, INSERT, "I", f" || chr(10) || '{who}:'")
    delete = lambda b: step(b, DELETE, "D")
    keep = lambda b, letter: step(b, f"CASE k WHEN '{letter}' THEN x ELSE 9999999 END", "K", " || chr(10) || role || ':' || text")
    rerole = lambda b, who: step(b, f"{REROLE} + x", "R", f" || chr(10) || '{who}:' || text")
    least = lambda *options: f"list_min([{', '.join(options)}])"
    s2 = least(delete("b2"), *(keep(b, "u") for b in ("b0", "b1", "b3")), *(rerole(b, "user") for b in ("b0", "b1", "b3")))
    s3 = least(delete("b3"), keep("b2", "a"), rerole("b2", "assistant"))
    user = least("s2", *(insert(b, "user") for b in ("s0", "s1", "s3")))
    assistant = least("s3", insert(f"({least('s2', insert('s0', 'user'), insert('s1', 'user'))})", "assistant"))
    return rf"""
    WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
    crc AS (SELECT *, {crc32_sql("key")} % 20 AS fault FROM src),
    dam AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM (SELECT *, unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE fault <> 0)),
    num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM dam),
    flt AS (SELECT *, substr(role, 1, 1) AS k, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM num),
    f AS (SELECT *, CASE WHEN tail = '' THEN 1 WHEN again THEN 2 WHEN tail NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS bad FROM flt),
    st AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (bad = 1) AS blank, count(*) FILTER (bad = 2) AS duplicate, count(*) FILTER (bad = 3) AS truncated, count(*) FILTER (before || k NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
    ids AS (SELECT DISTINCT conv_id FROM conversations),
    dp AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'o': ''}} AS b0, {{'c': 9999999, 'a': '', 'o': ''}} AS b1, {{'c': 3, 'a': 'I', 'o': chr(10) || 'user:'}} AS b2, {{'c': 6, 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS b3 FROM ids
        UNION ALL SELECT conv_id, i, s0, s1, {user}, {assistant}
        FROM (SELECT conv_id, i, {delete("b0")} AS s0, {least(delete("b1"), keep("b0", "s"))} AS s1, {s2} AS s2, {s3} AS s3
            FROM (SELECT dp.conv_id, f.i, b0, b1, b2, b3, k, role, text, CASE WHEN bad IN (1, 2) THEN 9999999 WHEN bad = 3 THEN {TRUNCATED} ELSE 0 END AS x FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1))),
    best AS (SELECT dp.conv_id, list_min([b0, b3]) AS b FROM dp LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE dp.i = coalesce(st.n, 0))
    SELECT best.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, b.c::BIGINT AS cost, b.a AS audit, sha256(substr(b.o, 2)) AS repaired_sha256
    FROM best LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM best.conv_id"""


ORACLE = _oracle()
