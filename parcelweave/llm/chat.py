"""Chat formatting in budgeted windows with a loss mask, and reading the result back.

Running sums of turn tokens cut a conversation into spans of whole turns that fit a budget. Every window opens with the
conversation's system turn, then repeats the last turns before its span within a limit; only assistant texts that are
new in a window lie under its loss mask, so each is a target once.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelweave.llm.frames import ship_package

BUDGET_TOKENS = 1024
HISTORY_TOKENS = 256
# Tokens a turn's marks cost, and bytes of text that count as one token, for the default count.
MARK_TOKENS = 4
BYTES_A_TOKEN = 4

# The template: fixed values that open and close a turn. Any other role is named in the turn.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN]", "[TEXT]", "[/TURN]")
TARGET = "assistant"
CONTROL = re.compile(
    r"\\.|" + "|".join(re.escape(m) for m in [*(m for pair in MARKS.values() for m in pair), *OTHER]), re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """No control string is left: each begins with [ or <."""
    return text.replace("\\", "\\\\").replace("[", "\\[").replace("<", "\\<")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def estimated_tokens(role: str, text: str) -> int:
    return -(-len(text.encode()) // BYTES_A_TOKEN) + MARK_TOKENS


def write_turn(role: str, text: str) -> tuple[str, str, str]:
    """The parts before, in and after the text."""
    if role in MARKS:
        return MARKS[role][0], escape(text), MARKS[role][1]
    return OTHER[0] + escape(role) + OTHER[1], escape(text), OTHER[2]


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text and the text's place in the formatted string, turn by turn."""
    opens = {pair[0]: role for role, pair in MARKS.items()}
    role, begin = "", 0
    for found in CONTROL.finditer(formatted):
        mark = found.group()
        if mark[0] == "\\":
            continue
        if mark in opens or mark == OTHER[0]:
            role, begin = opens.get(mark, ""), found.end()
        elif mark == OTHER[1]:
            role, begin = unescape(formatted[begin:found.start()]), found.end()
        else:
            yield role, unescape(formatted[begin:found.start()]), begin, found.start()


Turn = tuple[str, str, int]


@dataclass
class Spans:
    """The windows of one conversation as its turns arrive: system turn, history and current span are held, no more."""

    budget: int
    history_limit: int
    tokens: Callable[[str, str], int]
    system: list[Turn] = field(default_factory=list)
    history: deque[Turn] = field(default_factory=deque)
    current: list[Turn] = field(default_factory=list)
    room: int = 0
    upto: int = 0  # running sum of the turns since the span began
    number: int = 0

    def __post_init__(self) -> None:
        self.room = self.budget

    def add(self, role: str, text: str) -> Iterator[tuple]:
        turn = (role, text, self.tokens(role, text))
        if self.current and self.upto + turn[2] > self.room:
            yield self.window()
        if not self.number and not self.current and role == "system":
            self.system.append(turn)
        self.current.append(turn)
        self.upto += turn[2]

    def window(self) -> tuple:
        """(number, formatted, spans under loss, repeated turns, turns); the next span begins."""
        repeated = [*(self.system if self.number else []), *self.history]
        parts, low, spans = [], 0, []
        for i, (role, text, _) in enumerate([*repeated, *self.current]):
            before, inner, after = write_turn(role, text)
            parts += (before, inner, after)
            if i >= len(repeated) and role == TARGET and inner:
                spans.append((low + len(before), low + len(before) + len(inner)))
            low += len(before) + len(inner) + len(after)
        row = (self.number, "".join(parts), spans, len(repeated), len(repeated) + len(self.current))
        past = self.current[len(self.system):] if not self.number else self.current
        held = sum(t[2] for t in self.history)
        for turn in past:
            self.history.append(turn)
            held += turn[2]
            while held > self.history_limit:
                held -= self.history.popleft()[2]
        self.room = self.budget - held - sum(t[2] for t in self.system)
        self.current, self.upto, self.number = [], 0, self.number + 1
        return row


def format_windows(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    budget: int = BUDGET_TOKENS, history: int = HISTORY_TOKENS, tokens: Callable[[str, str], int] = estimated_tokens,
) -> DataFrame:
    """(conv_id, window, formatted, loss, repeated, turns): the windows of each conversation, numbered from 0.

    `loss` lists the places [low, high), in code points of `formatted`, of the targets; `repeated` says how many of the
    `turns` of a window opened it as system turn or history. A turn is never cut: one over the budget is a span alone.
    Turns go by number, then role and text, so ties and repeated rows are all kept; null numbers come first, a null role
    or text is empty, null ids are one conversation. Other columns are ignored. Turns are streamed in order, so a very
    long conversation needs no more memory than its largest window.
    """
    ship_package(conversations.sparkSession)
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema([
        ("conv_id", pa.int64()), ("window", pa.int64()), ("formatted", pa.string()),
        ("loss", pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))), ("repeated", pa.int64()), ("turns", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, spans = None, None
        for batch in batches:
            out = []
            for own, who, what in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if spans is None or own != key:
                    if spans is not None:
                        out.append((key, *spans.window()))
                    key, spans = own, Spans(budget, history, tokens)
                out += [(key, *w) for w in spans.add(who, what)]
            if out:
                yield _batch(out, schema)
        if spans is not None:
            yield _batch([(key, *spans.window())], schema)

    return rows.mapInArrow(run, "conv_id bigint, window bigint, formatted string, loss array<struct<low:bigint,high:bigint>>, "
                                "repeated bigint, turns bigint")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    if "loss" in schema.names:
        at = schema.names.index("loss")
        columns[at] = [[{"low": a, "high": b} for a, b in spans] for spans in columns[at]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Digest:
    """What is read back from the windows of one conversation, in order."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.formatted_chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[dict], repeated: int) -> None:
        self.formatted_chars += len(formatted)
        for i, (role, text, _, _) in enumerate(read_turns(formatted)):
            if i >= repeated:
                self.turns += 1
                self.all.update(f"{role}\n{text}\n".encode())
        for span in loss:
            text = unescape(formatted[span["low"]:span["high"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the output of format_windows.

    Repeated turns are left out by their count, targets are taken from the loss mask alone. Digests run over the turns
    in order, so a conversation is streamed through one task.
    """
    rows = windows.select("conv_id", "window", "formatted", "loss", "repeated").repartition("conv_id").sortWithinPartitions(
        "conv_id", "window")
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            names = ("conv_id", "formatted", "loss", "repeated")
            for own, formatted, loss, repeated in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if digest is None or own != key:
                    if digest is not None:
                        out.append((key, *digest.row()))
                    key, digest = own, Digest()
                digest.add(formatted, loss, repeated)
            if out:
                yield _batch(out, schema)
        if digest is not None:
            yield _batch([(key, *digest.row())], schema)

    return rows.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
                                "formatted_chars bigint")


# The same windows for DuckDB, turn by turn; `costs` and `chars` hold the history and then the open span, `held` of them
# history. Two turns of conversation -7 are added to the table.
CHECK_SQL = f"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM said),
sized AS (
  SELECT conv_id, k, role = 'system' AND k = 1 AS leads, (strlen(text) + {BYTES_A_TOKEN - 1}) // {BYTES_A_TOKEN} + {MARK_TOKENS} AS cost,
         length(regexp_replace(text, '([\\\\\\[<])', '..', 'g')) + CASE role
           WHEN 'system' THEN {sum(map(len, MARKS["system"]))} WHEN 'user' THEN {sum(map(len, MARKS["user"]))}
           WHEN 'assistant' THEN {sum(map(len, MARKS["assistant"]))}
           ELSE {sum(map(len, OTHER))} + length(regexp_replace(role, '([\\\\\\[<])', '..', 'g')) END AS chars
  FROM turns),
walk AS (
  SELECT conv_id, k, leads, CASE WHEN leads THEN cost ELSE 0 END AS lead_cost, CASE WHEN leads THEN chars ELSE 0 END AS lead_chars,
         0::BIGINT AS number, 0::BIGINT AS held, [cost] AS costs, [chars] AS sizes, {BUDGET_TOKENS}::BIGINT AS room, 0::BIGINT AS done
  FROM sized WHERE k = 1
  UNION ALL
  SELECT conv_id, k, leads, lead_cost, lead_chars, number + CASE WHEN fits THEN 0 ELSE 1 END,
         CASE WHEN fits THEN held ELSE len(costs) + 1 - cut END,
         list_append(CASE WHEN fits THEN costs ELSE costs[cut:] END, cost),
         list_append(CASE WHEN fits THEN sizes ELSE sizes[cut:] END, chars),
         CASE WHEN fits THEN room ELSE {BUDGET_TOKENS} - lead_cost - coalesce(list_sum(costs[cut:]), 0)::BIGINT END,
         CASE WHEN fits THEN done ELSE done + list_sum(sizes)::BIGINT + CASE WHEN number > 0 THEN lead_chars ELSE 0 END END
  FROM (
    SELECT w.* EXCLUDE (k), s.k, s.cost, s.chars,
           coalesce(list_sum(w.costs[w.held + 1:]), 0) + s.cost <= w.room AS fits,
           list_filter(range(CASE WHEN w.number = 0 AND w.leads THEN 2 ELSE 1 END, len(w.costs) + 2),
                       lambda p: coalesce(list_sum(w.costs[p:]), 0) <= {HISTORY_TOKENS})[1] AS cut
    FROM walk w JOIN sized s ON s.conv_id = w.conv_id AND s.k = w.k + 1)),
ends AS (
  SELECT conv_id, done + list_sum(sizes)::BIGINT + CASE WHEN number > 0 THEN lead_chars ELSE 0 END AS formatted_chars
  FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1),
read AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
         coalesce(sum(length(text)) FILTER (role = '{TARGET}'), 0)::BIGINT AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = '{TARGET}'), '')) AS loss_sha256
  FROM turns GROUP BY conv_id)
SELECT * FROM read JOIN ends USING (conv_id)
"""
