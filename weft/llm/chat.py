"""Operator 5: chat formatting in budgeted windows.

Turns of a conversation are cut into windows of whole turns. Prefix sums of turn tokens choose each
window's span: as many turns as fit the budget beside the system turn (kept in every window) and up
to HISTORY repeated turns before the span, which are left out again, oldest first, where they do
not fit. A turn that is alone over the budget has a window of its own and stays whole. The loss mask
holds each assistant text once: repeated turns are masked.

The template is START role newline text newline END newline. Control strings inside texts and
roles get 2n+1 backslashes, n being the backslashes before them; in an escaped text a control
string thus never stands after an even number, and the template's own always do. That is undone by
read_back. Roles also have their newlines escaped.

Conversations are dealt by conv_id, sorted by turn, and streamed: a task holds one window at a
time, however many turns a conversation has. (Its digest is sequential, so one conversation's
turns pass through one task.)

Defined results: a null text or role is empty; turns that repeat a number are ordered by role and
text and all kept; a null turn comes first; rows without conv_id are left out; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.core import tidied

START, END = "<|turn|>", "<|end|>"
CONTROL = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BUDGET = 1024
HISTORY = 2
_ANY = "|".join(map(re.escape, CONTROL))
_RAW, _ESCAPED = re.compile(rf"(\\*)({_ANY})"), re.compile(rf"(\\+)({_ANY})")


def escape(text: str) -> str:
    return _RAW.sub(lambda m: "\\" * (2 * len(m[1]) + 1) + m[2], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" * ((len(m[1]) - 1) // 2) + m[2], text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A").replace("\\", "%5C"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%5C", "\\").replace("%0A", "\n").replace("%25", "%")


def tokens(text: str) -> int:
    """A turn's size for the budget: a token for each four bytes begun, and four for its marks."""
    return (len(text.encode()) + 3) // 4 + 4


def windows(turns: Iterator[tuple[str, str]], budget: int, history: int, count: Callable[[str], int]) -> Iterator[tuple[str, list[tuple[int, int]], int, int]]:
    """Of one conversation: (text, spans of the loss mask, first turn, repeated turns) of each window."""
    system: tuple[str, str, int] | None = None
    past: list[tuple[str, str, int]] = []
    span: list[tuple[str, str, int]] = []
    used = at = 0

    def made() -> tuple[str, list[tuple[int, int]], int, int]:
        room = budget - used - (system[2] if system and at else 0)
        kept: list[tuple[str, str, int]] = []
        for turn in reversed(past[-history:] if history else []):
            if turn is system or turn[2] > room:
                break
            kept.insert(0, turn)
            room -= turn[2]
        again = ([system] if system and at else []) + kept
        text, spans = [], []
        length = 0
        for i, (role, body, _) in enumerate([*again, *span]):
            head, inner = f"{START}{escape_role(role)}\n", escape(body)
            if role == "assistant" and i >= len(again):
                spans.append((length + len(head), length + len(head) + len(inner)))
            text.append(f"{head}{inner}\n{END}\n")
            length += len(text[-1])
        return "".join(text), spans, at, len(again)

    for role, body in turns:
        turn = (role, body, count(body))
        if span and used + turn[2] + (system[2] if system and at else 0) > budget:
            yield made()
            at += len(span)
            past, span, used = [*past, *span][-max(history, 1) :], [], 0
        if role == "system" and system is None and at == 0 and not span:
            system = turn
        span.append(turn)
        used += turn[2]
    if span:
        yield made()


def read_back(text: str, spans: list[tuple[int, int]], repeated: int) -> tuple[list[tuple[str, str]], list[str]]:
    """The window's own turns, and the texts under its loss mask, both unescaped."""
    turns, at, n = [], 0, 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError("not a formatted window")
        head = text.index("\n", at)
        # an END of the template stands after a newline, an escaped one after a backslash
        end = text.index(f"\n{END}\n", head)
        if n >= repeated:
            turns.append((unescape_role(text[at + len(START) : head]), unescape(text[head + 1 : end])))
        n += 1
        at = end + len(END) + 2
    return turns, [unescape(text[a:b]) for a, b in spans]


_FORMATTED = "conv_id long, window int, text string, loss_spans array<struct<start:int,end:int>>, first_turn long, n_repeated int"


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[str, str]]]]:
    rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
    waiting = next(rows, None)
    while waiting is not None:
        conv = waiting[0]

        def turns() -> Iterator[tuple[str, str]]:
            nonlocal waiting
            while waiting is not None and waiting[0] == conv:  # noqa: B023
                yield waiting[1], waiting[2]
                waiting = next(rows, None)

        yield conv, turns()


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, count: Callable[[str], int] = tokens) -> DataFrame:
    """conv_id, window, text, loss_spans (character offsets), first_turn and n_repeated of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, turns in _conversations(batches):
            for i, (text, spans, first, repeated) in enumerate(windows(turns, budget, history, count)):
                out.append((conv, i, text, [{"start": a, "end": b} for a, b in spans], first, repeated))
                size += len(text)
                if size > 4 << 20:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(tidied(run), _FORMATTED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int64(), pa.int32())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "window", "text", "loss_spans", "first_turn", "n_repeated"])


def digests(formatted: DataFrame) -> DataFrame:
    """What the windows of each conversation say, read back in the order in which they were made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, n, turns_hash, loss, loss_hash, size = None, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
        for b in batches:
            for key, text, spans, repeated in zip(*(b.column(c).to_pylist() for c in (0, 2, 3, 5)), strict=True):
                if key != conv:
                    if conv is not None:
                        out.append((conv, n, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), size))
                    conv, n, turns_hash, loss, loss_hash, size = key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                turns, targets = read_back(text, [(s["start"], s["end"]) for s in spans], repeated)
                for role, body in turns:
                    turns_hash.update(f"{role}\n{body}\n".encode())
                for target in targets:
                    loss_hash.update(target.encode())
                    loss += len(target)
                n, size = n + len(turns), size + len(text)
        if conv is not None:
            out.append((conv, n, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), size))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(tidied(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: digests of all conversations, and of one that says control strings, read back from their windows."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return digests(format_conversations(rows.unionByName(extra)))


def _oracle() -> str:
    """The same by a recursion over turns: which window each is in, then what the windows repeat."""
    controls = "|".join(c.replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for c in CONTROL)
    escaped = lambda x: rf"regexp_replace({x}, '(\\*)({controls})', '\1\\\1\2', 'g')"
    frame, said = len(START) + len(END) + 3, CONTROL[3] + CONTROL[4] + " ok " + CONTROL[5]
    return rf"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS k
  FROM (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{said}'), (-7, 1, 'assistant', '{said}')))
), c AS (
  SELECT *, (octet_length(encode(text)) + 3) // 4 + 4 AS cost,
    length({escaped("replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), chr(92), '%5C')")}) + length({escaped("text")}) + {frame} AS size FROM t
), sys AS (
  SELECT conv_id, cost AS sys_cost, size AS sys_size FROM c WHERE k = 0 AND role = 'system'
), w(conv_id, k, a, used) AS (
  SELECT conv_id, k, CAST(0 AS BIGINT), CAST(cost AS BIGINT) FROM c WHERE k = 0
  UNION ALL
  SELECT conv_id, k, CASE WHEN over THEN k ELSE a END, CASE WHEN over THEN cost ELSE used + cost END FROM (
    SELECT c.conv_id, c.k, w.a, w.used, c.cost, w.used + c.cost + CASE WHEN w.a > 0 THEN coalesce(sys_cost, 0) ELSE 0 END > {BUDGET} AS over
    FROM w JOIN c ON c.conv_id = w.conv_id AND c.k = w.k + 1 LEFT JOIN sys ON sys.conv_id = w.conv_id)
), win AS (
  SELECT w.conv_id, w.a, {BUDGET} - max(used) - coalesce(any_value(sys_cost), 0) AS room, coalesce(any_value(sys_size), 0) AS sys_size, CASE WHEN any_value(sys_cost) IS NULL THEN 0 ELSE 1 END AS least
  FROM w LEFT JOIN sys ON sys.conv_id = w.conv_id WHERE w.a > 0 GROUP BY w.conv_id, w.a
), again AS (
  SELECT win.conv_id, sum(sys_size + CASE WHEN x.cost <= room THEN x.size + CASE WHEN y.cost <= room - x.cost THEN y.size ELSE 0 END ELSE 0 END) AS size
  FROM win LEFT JOIN c x ON x.conv_id = win.conv_id AND x.k = a - 1 AND x.k >= least
  LEFT JOIN c y ON y.conv_id = win.conv_id AND y.k = a - 2 AND y.k >= least GROUP BY win.conv_id
), total AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss, sum(size) AS size FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(total.size + coalesce(again.size, 0) AS BIGINT) AS formatted_chars
FROM total LEFT JOIN again USING (conv_id)
"""


ORACLE_SQL = _oracle()
