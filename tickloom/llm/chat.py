"""Chat formatting in budgeted windows: whole turns, the system turn kept, limited history repeated, repeated targets masked.

A turn is written as `### role:`, a line end, its text, `</turn>` and a line end. Control strings inside roles and texts (`##`,
`</turn>`, `<|` of special tokens, the backslash) are broken up by a backslash, which reading back takes out again, so every text
comes back as it was. Tokens are counted for each written turn, before any shuffle; prefix sums of these counts choose the spans: a
window holds the system turn, then up to `history` tokens of the turns just before (whole ones), then as many new turns as the budget
allows. The loss mask covers the texts of new assistant turns only, so over all windows each stands in it once.

Rows of a conversation go by turn; ties by role, then text; repeated rows are turns of their own. A null turn number comes first, a null
role or text is empty, rows without an id are one conversation. The system turn is the conversation's first row of the role `system`;
windows that begin later repeat it, unless it takes more than half the budget: then it stands only in its own place. History gives way
where the next turn would not fit; a turn that doesn't fit even so stands alone with the system turn in a window over the budget, never
cut. A stretch of `stretch` turn numbers begins a new window without history: so the stretches of a conversation with more than
`hot_rows` rows, and more than a ten-thousandth of all rows (at most 10,000 have), are worked off in different tasks, with the same
windows. Any other conversation is one sorted run of a task, held a thousand turns at a time. Other columns are not read; an empty table gives no
windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tickloom.llm import bpe
from tickloom.llm.common import slices

END = "</turn>\n"
_BREAKS = re.compile(r"(?<=#)(?=#)|(?<=<)(?=/turn>|\|)")
#: Turns that are held before their windows are cut, and bytes of text of a batch that a task gives out.
HELD, OUT_BYTES = 1024, 4 << 20


def escape(text: str) -> str:
    return _BREAKS.sub(r"\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL) if "\\" in text else text


def head(role: str) -> str:
    return f"### {escape(role).replace(chr(10), chr(92) + 'n')}:\n"


def written_turn(role: str, text: str) -> str:
    return head(role) + escape(text) + END


def read_turns(text: str) -> list[tuple[str, str, int, int]]:
    """The turns of a written window: role, text, and where the escaped text starts and ends."""
    out, at = [], 0
    while at < len(text):
        colon, end = text.index(":\n", at), text.index(END, at)
        out.append((unescape(text[at + 4 : colon]), unescape(text[colon + 2 : end]), colon + 2, end))
        at = end + len(END)
    return out


def spans(tokens: list[int], system: int, seen: int, budget: int, history: int, start: int = 0) -> list[tuple[int, int, int]]:
    """Windows over turns of so many tokens, from turn `start` on: first repeated turn, first new turn, end.

    system: tokens of a system turn before all of these, 0 if there is none; seen: place of the system turn among these, -1 if it isn't."""
    upto = np.concatenate([[0], np.cumsum(tokens)])
    out, at = [], start
    while at < len(tokens):
        if 0 <= seen < at and not system:
            own = int(tokens[seen])
            first, keep = (seen + 1, own) if 2 * own <= budget else (0, 0)
        else:
            first, keep = 0, system
        room = budget - keep
        back = max(first, int(np.searchsorted(upto, upto[at] - min(history, max(0, room - tokens[at])), "left"))) if history else at
        back = min(back, at)
        end = max(at + 1, int(np.searchsorted(upto, upto[back] + room, "right")) - 1)
        out.append((back, at, end))
        at = end
    return out


class _Conversation:
    """Cuts the windows of one conversation, whose turns come in order."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple | None = None  # (role, text, tokens) of a system turn that is no longer held
        self.begin(None)

    def begin(self, stretch) -> None:
        self.stretch, self.turns, self.new, self.window, self.seen = stretch, [], 0, 0, -1

    def add(self, turn: tuple) -> Iterator[tuple]:
        if turn[0] == "system" and self.system is None and self.seen < 0:
            self.seen = len(self.turns)
        self.turns.append(turn)
        if len(self.turns) - self.new >= HELD:
            yield from self.cut(final=False)

    def cut(self, final: bool) -> Iterator[tuple]:
        if self.new >= len(self.turns):
            return
        before = self.system if self.system and 2 * self.system[2] <= self.budget else None
        found = spans([t[2] for t in self.turns], before[2] if before else 0, self.seen, self.budget, self.history, self.new)
        for back, at, end in found if final else found[:-1]:
            kept = before
            if not kept and 0 <= self.seen < back and 2 * self.turns[self.seen][2] <= self.budget:
                kept = self.turns[self.seen]
            yield self._written(([kept] if kept else []) + self.turns[back:at], self.turns[at:end])
        if final:
            if self.seen >= 0:
                self.system = self.turns[self.seen]
            return
        back, at, _ = found[-1]
        if 0 <= self.seen < back:
            self.system, self.seen = self.turns[self.seen], -1
        elif self.seen >= back:
            self.seen -= back
        self.turns, self.new = self.turns[back:], at - back

    def _written(self, old: list[tuple], new: list[tuple]) -> tuple:
        parts, loss, at = [], [], 0
        for k, (role, text, _) in enumerate(old + new):
            parts.append(written_turn(role, text))
            if k >= len(old) and role == "assistant":
                loss.append((at + len(head(role)), at + len(parts[-1]) - len(END)))
            at += len(parts[-1])
        self.window += 1
        return self.stretch, self.window - 1, "".join(parts), len(old) + len(new), len(old), sum(t[2] for t in old + new), loss


_SHAPE = "stretch bigint, window int, text string, n_turns int, n_repeated int, n_tokens bigint, loss array<struct<a:int,b:int>>"
_LOSS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _batch(id_type: pa.DataType, id_col: str, rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    starts = np.cumsum([0, *map(len, c[7])]).astype(np.int32)
    flat = [x for loss in c[7] for x in loss]
    loss = pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.int32()) for k in (0, 1)], names=["a", "b"]))
    kinds = [id_type, pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([*(pa.array(v, k) for v, k in zip(c[:7], kinds, strict=True)), loss.cast(_LOSS)], names=[id_col, "stretch", "window", "text", "n_turns", "n_repeated", "n_tokens", "loss"])


def _counted(rows: DataFrame, path: str | None) -> DataFrame:
    """The rows with the tokens of each written turn."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns)

    def work(batches):
        enc = bpe.encoder(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                turns = zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)
                counts = [len(enc.encode(written_turn(r, t), 16384)) // 4 for r, t in turns]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, "tokens"])

    return rows.mapInArrow(work, f"{kinds}, tokens bigint")


def _windows(rows: DataFrame, split: bool, id_col: str, budget: int, history: int, path: str | None) -> DataFrame:
    """Windows of rows (id, stretch, turn, role, text), in order within each task. split: every stretch may go to a task of its own."""
    rows = _counted(rows, path)
    if split:  # a stretch can't see the system turn of an earlier one
        first = rows.where(F.col("role") == "system").groupBy("id").agg(F.min(F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("at"), "text", "stretch", "tokens")).alias("s"))
        first = first.select(F.col("id").alias("sid"), F.col("s.stretch").alias("ss"), F.col("s.text").alias("st"), F.col("s.tokens").alias("sn"))
        rows = rows.repartition("id", "stretch").join(first, F.col("id").eqNullSafe(F.col("sid")) & (F.col("ss") < F.col("stretch")), "left").drop("sid", "ss")
    rows = rows.repartition("id", "stretch") if split else rows.repartition("id")
    id_type = to_arrow_type(rows.schema["id"].dataType)
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches):
        chat, last, held, size = None, None, [], 0
        for whole in batches:
            for batch in slices(whole, "text"):
                columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
                for k in range(batch.num_rows):
                    name = columns["id"][k], columns["stretch"][k]
                    if name != last:
                        if chat:
                            held += [(last[0], *w) for w in chat.cut(final=True)]
                        if not chat or split or name[0] != last[0]:
                            chat = _Conversation(budget, history)
                            if split and columns["st"][k] is not None:
                                chat.system = ("system", columns["st"][k], columns["sn"][k])
                        chat.begin(name[1])
                        last = name
                    for w in chat.add((columns["role"][k], columns["text"][k], columns["tokens"][k])):
                        held.append((last[0], *w))
                    size += len(columns["text"][k]) + 64
                    if size >= OUT_BYTES and held:
                        yield _batch(id_type, id_col, held)
                        held, size = [], 0
        if chat:
            held += [(last[0], *w) for w in chat.cut(final=True)]
        if held:
            yield _batch(id_type, id_col, held)

    return rows.sortWithinPartitions("id", "stretch", "turn", "role", "text").mapInArrow(work, f"`{id_col}` {kind}, {_SHAPE}")


def _parts(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, budget: int, history: int, path: str | None, stretch: int, hot_rows: int) -> list[tuple[DataFrame, bool]]:
    """The windows, in one DataFrame or two, and of each whether a conversation's windows are in order in one task."""
    n = turns.count()
    bar = max(hot_rows, n // 10_000)
    hot = [r[0] for r in turns.groupBy(F.col(id_col).alias("id")).count().where(F.col("count") > bar).select("id").collect()] if n > hot_rows else []  # at most 10,000
    rows = turns.select(
        F.col(id_col).alias("id"), F.coalesce(F.expr(f"`{turn_col}` div {stretch}"), F.lit(-(1 << 62))).alias("stretch"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"),
    )
    if not hot:
        return [(_windows(rows, False, id_col, budget, history, path), True)]
    is_hot = reduce(lambda a, b: a | b, [F.col("id").isin([h for h in hot if h is not None]), *([F.col("id").isNull()] if None in hot else [])])
    is_hot = F.coalesce(is_hot, F.lit(False))
    return [(_windows(rows.where(~is_hot), False, id_col, budget, history, path), True), (_windows(rows.where(is_hot), True, id_col, budget, history, path), False)]


def chat_windows(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = 2048, history: int = 512, path: str | None = None, stretch: int = 1024, hot_rows: int = 16384) -> DataFrame:
    """One row per window: id, stretch and window (their order within the conversation), text, n_turns, n_repeated (system turn and history, which come first), n_tokens, loss (spans in code points).

    path: a tokenizers-library file that every executor can open; by default the public byte-level BPE of 50k tokens."""
    return reduce(DataFrame.unionByName, [w for w, _ in _parts(turns, id_col, turn_col, role_col, text_col, budget, history, path, stretch, hot_rows)])


def _digests(windows: DataFrame, id_col: str) -> DataFrame:
    """Digests of windows that come in order, each conversation's in one task: one pass that holds a window at a time."""
    kind = windows.schema[id_col].dataType
    id_type = to_arrow_type(kind)
    names = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def work(batches):
        last, state, done = None, None, []
        for whole in batches:
            for batch in slices(whole, "text"):
                for r in zip(*(batch.column(n).to_pylist() for n in (id_col, "text", "n_repeated", "loss")), strict=True):
                    if state is None or r[0] != last:
                        if state:
                            done.append((last, *state))
                        last, state = r[0], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, text, _, _ in read_turns(r[1])[r[2] :]:
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode())
                    for span in r[3]:
                        under = unescape(r[1][span["a"] : span["b"]])
                        state[2] += len(under)
                        state[3].update(under.encode())
                    state[4] += len(r[1])
                if len(done) >= 4096:
                    yield rows_of(done)
                    done = []
        if state:
            done.append((last, *state))
        if done:
            yield rows_of(done)

    def rows_of(done):
        c = [list(x) for x in zip(*done, strict=True)]
        columns = [pa.array(c[0], id_type), pa.array(c[1], pa.int64()), pa.array([h.hexdigest() for h in c[2]]), pa.array(c[3], pa.int64()), pa.array([h.hexdigest() for h in c[4]]), pa.array(c[5], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return windows.mapInArrow(work, f"`{id_col}` {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def conversation_digests(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = 2048, history: int = 512, path: str | None = None, stretch: int = 1024, hot_rows: int = 16384) -> DataFrame:
    """Per conversation, read back from its windows: n_turns, digest of all turns, code points and digest of what is under the loss mask, code points written.

    A digest of a whole conversation takes its bytes one after the other, so a hot conversation's windows pass through one task here, one at a time; cutting them doesn't."""
    out = []
    for windows, ordered in _parts(turns, id_col, turn_col, role_col, text_col, budget, history, path, stretch, hot_rows):
        out.append(_digests(windows if ordered else windows.repartition(id_col).sortWithinPartitions(id_col, "stretch", "window"), id_col))
    return reduce(DataFrame.unionByName, out)
