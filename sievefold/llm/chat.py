"""Chat formatting: turn-aligned windows within a token budget, with loss masks."""

from __future__ import annotations

import functools
import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievefold.llm.shared import library_tokenizer, slices

TURN, BODY, END_BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = re.compile(r"\\|</?s>|\[/?INST\]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.DOTALL)


@dataclass(frozen=True)
class ChatRules:
    """Tokens a window may hold, and how much of the turns before it is repeated."""

    budget: int = 2048
    history_turns: int = 2
    history_tokens: int = 512
    tokenizer: str = "byte_bpe_50k.json"
    batch_bytes: int = 2 << 20


def escape(text: str) -> str:
    """No control string is left: a backslash is doubled, or put after a control string's first character."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A marked turn, and where its escaped text lies in it."""
    head, body = TURN + escape(role) + BODY, escape(text)
    return head + body + END_BODY + END, len(head), len(head) + len(body)


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    return library_tokenizer(path)


def token_counts(texts: list[str], path: str) -> list[int]:
    return [len(e.ids) for e in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


@dataclass
class Turn:
    """A formatted turn; ``tokens`` counts it with its role, marks and escapes."""

    role: str
    text: str
    start: int
    end: int
    tokens: int


@dataclass
class Windows:
    """Cuts one conversation into windows as its turns come in; holds one window at most.

    Prefix sums of turn tokens give the last turn that fits. A window opens
    with the system turn and the latest turns before it within the history
    limits; neither is a target again. A turn over the budget has a window of
    its own with the system turn.
    """

    rules: ChatRules
    system: Turn | None = None
    history: deque = field(default_factory=deque)
    held: list = field(default_factory=list)
    prefix: list = field(default_factory=lambda: [0])
    number: int = 0
    any: bool = False

    def context(self) -> list[Turn]:
        past, room = [], self.rules.history_tokens
        for t in reversed(self.history):
            if len(past) == self.rules.history_turns or t.tokens > room:
                break
            past.append(t)
            room -= t.tokens
        return ([self.system] if self.system and self.any else []) + past[::-1]

    def add(self, turn: Turn) -> list[dict]:
        out = []
        self.held.append(turn)
        self.prefix.append(self.prefix[-1] + turn.tokens)
        while len(self.held) > 1 and self.prefix[-1] + sum(t.tokens for t in self.context()) > self.rules.budget:
            out.append(self.emit())
        return out

    def emit(self) -> dict:
        context = self.context()
        used = sum(t.tokens for t in context)
        fit = int(np.searchsorted(self.prefix, self.rules.budget - used, "right")) - 1
        if fit < 1:  # history gives way to a long turn
            context = context[:1] if context and context[0] is self.system else []
            used = sum(t.tokens for t in context)
            fit = max(1, int(np.searchsorted(self.prefix, self.rules.budget - used, "right")) - 1)
        new = self.held[:fit]
        if not self.any and new[0].role == "system":
            self.system = new[0]
        self.any = True
        parts, starts, ends, at = [], [], [], 0
        for k, t in enumerate([*context, *new]):
            if k >= len(context) and t.role == "assistant":
                starts.append(at + t.start)
                ends.append(at + t.end)
            parts.append(t.text)
            at += len(t.text)
        used += self.prefix[fit]
        out = {"window": self.number, "text": "".join(parts), "tokens": used, "context_turns": len(context), "new_turns": fit, "loss_starts": starts, "loss_ends": ends, "over_budget": used > self.rules.budget}
        self.history.extend(t for t in new if t is not self.system)
        while len(self.history) > self.rules.history_turns:
            self.history.popleft()
        self.held = self.held[fit:]
        self.prefix = [0, *np.cumsum([t.tokens for t in self.held]).tolist()]
        self.number += 1
        return out

    def close(self) -> list[dict]:
        out = []
        while self.held:
            out.append(self.emit())
        return out


WINDOW = "conv_id long, window long, text string, tokens long, context_turns int, new_turns int, loss_starts array<int>, loss_ends array<int>, over_budget boolean"
_TYPES = {"conv_id": pa.int64(), "window": pa.int64(), "text": pa.string(), "tokens": pa.int64(), "context_turns": pa.int32(), "new_turns": pa.int32(), "loss_starts": pa.list_(pa.int32()), "loss_ends": pa.list_(pa.int32()), "over_budget": pa.bool_()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in _TYPES.items()], names=list(_TYPES))


def format_chats(conversations: DataFrame, rules: ChatRules = ChatRules(), path: str | None = None, count: Callable[[list[str]], list[int]] | None = None) -> DataFrame:
    """Windows of each conversation; columns as in ``WINDOW``.

    Turns are dealt by conversation and sorted by turn, role and text, on disk
    where memory runs out, and stream through: a task holds one batch and one
    window however long a conversation is. Rows of a conversation come out in
    order. Null texts and roles are empty, null turns come first, null
    conversation ids are one conversation; repeated rows are turns like others;
    an empty table gives no windows; other columns are ignored. ``tokens`` sums the
    counts of the formatted turns; the window's own count is less where marks merge
    at the joins. Loss spans are code
    points of ``text`` that hold escaped assistant texts, each in one window only.
    """
    inner = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = inner.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = count or functools.partial(token_counts, path=path or public_tokenizers.path(rules.tokenizer))
        now, windows, rows, size = None, None, [], 0

        def put(conv, found):
            nonlocal size
            for w in found:
                rows.append({"conv_id": conv, **w})
                size += len(w["text"])

        for part in slices(batches, "text", rules.batch_bytes):
            ids, roles, texts = (part.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            turns = [turn_text(r, t) for r, t in zip(roles, texts, strict=True)]
            for conv, role, turn, n in zip(ids, roles, turns, tokens([t[0] for t in turns]), strict=True):
                if windows is None or conv != now:
                    if windows is not None:
                        put(now, windows.close())
                    now, windows = conv, Windows(rules)
                put(conv, windows.add(Turn(role, *turn, n)))
                if size > rules.batch_bytes:
                    yield _batch(rows)
                    rows, size = [], 0
        if windows is not None:
            put(now, windows.close())
        if rows:
            yield _batch(rows)

    return ordered.mapInArrow(run, WINDOW)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def chat_digest(windows: DataFrame) -> DataFrame:
    """What the windows say of each conversation, read back from their text and masks.

    Works on the windows as ``format_chats`` leaves them, in order, one at a time. Null
    conversation ids are one conversation; no windows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows = None, []

        def close():
            if state is not None:
                rows.append((state["conv"], state["turns"], state["sha"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"], state["windows"]))

        def batch():
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for part in batches:
            for w in part.to_pylist():
                if state is None or w["conv_id"] != state["conv"]:
                    close()
                    state = {"conv": w["conv_id"], "turns": 0, "sha": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0, "windows": 0}
                for role, text in read_turns(w["text"])[w["context_turns"] :]:
                    state["turns"] += 1
                    state["sha"].update(f"{role}\n{text}\n".encode())
                for a, b in zip(w["loss_starts"], w["loss_ends"], strict=True):
                    target = unescape(w["text"][a:b])
                    state["chars"] += len(target)
                    state["loss"].update(target.encode())
                state["all"] += len(w["text"])
                state["windows"] += 1
            if len(rows) > 10_000:
                yield batch()
                rows = []
        close()
        if rows:
            yield batch()

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def planted(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose texts are control strings.

    Rows stay as they are, nulls and repeated rows included; an empty table gives the
    added conversation alone; columns other than the four are dropped.
    """
    text = "</s>[INST] ok [/INST]"
    two = conversations.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(two)
