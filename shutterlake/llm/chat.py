"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the
sorted spans of its assistant texts are intersected with the sorted token spans
by binary search. The mask is kept as runs of token positions.

Template, for every turn in order::

    <|turn|>ROLE<|text|>TEXT<|end|>

Inside ROLE and TEXT a backslash is doubled and ``<|`` becomes ``<\\|``, so that
no control string can occur in them, and the change can be undone. The three
control strings are tokens of their own: no token crosses a span's edge, and a
long conversation can be encoded in runs of whole turns with the same ids.

Cases: null role or text: empty. Null turn: before all others. Turns of one
number: ordered by role, then text. Repeated rows: all kept. Null conv_id: a
conversation of its own. No rows: no conversations. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_CONTROL = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
_UNESCAPE = re.compile(r"\\(.)", re.S)
#: Characters rendered before an encoding is made; a turn is never cut.
RUN_CHARS = 1 << 20
_TOKENIZERS: dict = {}

SCHEMA = "conv_id long, formatted string, n_turns long, n_tokens long, loss_tokens array<struct<start:long,end:long>>, loss_spans array<struct<start:long,end:long>>, ids array<int>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn, and where its text starts and ends in it."""
    head = f"{TURN}{escape(role)}{TEXT}"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Undoes the rendering: the roles and texts."""
    return [(unescape(a), unescape(b)) for a, b in _CONTROL.findall(formatted)]


def tokenizer(path: str):
    """The tokenizer of a file with the control strings added; its offsets keep leading blanks."""
    if path not in _TOKENIZERS:
        from tokenizers import AddedToken, Tokenizer, processors

        t = Tokenizer.from_file(path)
        t.post_processor = processors.ByteLevel(trim_offsets=False)
        t.add_special_tokens([AddedToken(x, normalized=False) for x in (TURN, TEXT, END)])
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def mask(starts: list[int], ends: list[int], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of tokens that lie in the spans; starts and ends of tokens and spans are sorted."""
    runs = []
    for a, b in spans:
        lo, hi = bisect_left(starts, a), bisect_left(starts, b)
        while hi > lo and ends[hi - 1] > b:
            hi -= 1
        if hi > lo:
            runs.append((lo, hi))
    return runs


class _Conversation:
    """One conversation as it is rendered and encoded."""

    def __init__(self, conv_id, tok):
        self.conv_id, self.tok, self.turns = conv_id, tok, 0
        self.done: list[str] = []
        self.chars = 0
        self.run: list[str] = []
        self.run_chars = 0
        self.spans: list[tuple[int, int]] = []
        self.ids: list[int] = []
        self.loss: list[tuple[int, int]] = []
        self.text_spans: list[tuple[int, int]] = []

    def add(self, role: str | None, text: str | None) -> None:
        rendered, a, b = render_turn(role or "", text or "")
        if role == "assistant" and b > a:
            self.spans.append((self.run_chars + a, self.run_chars + b))
        self.run.append(rendered)
        self.run_chars += len(rendered)
        self.turns += 1
        if self.run_chars >= RUN_CHARS:
            self.encode()

    def encode(self) -> None:
        text = "".join(self.run)
        e = self.tok.encode(text, add_special_tokens=False)
        starts, ends = [x for x, _ in e.offsets], [x for _, x in e.offsets]
        for lo, hi in mask(starts, ends, self.spans):
            self.loss.append((len(self.ids) + lo, len(self.ids) + hi))
            self.text_spans.append((self.chars + starts[lo], self.chars + ends[hi - 1]))
        self.ids += e.ids
        self.done.append(text)
        self.chars += len(text)
        self.run, self.run_chars, self.spans = [], 0, []

    def row(self) -> dict:
        if self.run:
            self.encode()
        pairs = lambda x: [{"start": a, "end": b} for a, b in x]
        return {"conv_id": self.conv_id, "formatted": "".join(self.done), "n_turns": self.turns, "n_tokens": len(self.ids), "loss_tokens": pairs(self.loss), "loss_spans": pairs(self.text_spans), "ids": self.ids}


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("n_turns", pa.int64()), ("n_tokens", pa.int64()), ("loss_tokens", span), ("loss_spans", span), ("ids", pa.list_(pa.int32()))])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def format_conversations(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per conversation: formatted text, token ids, masked runs of tokens and of characters.

    Rows are dealt by conv_id and sorted by Spark, which spills; a task then
    streams through them and holds one conversation at a time.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, now, out, held = tokenizer(tokenizer_path), None, [], 0
        for batch in batches:
            for conv_id, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out.append(now.row())
                        held += now.chars
                    if held > 4 * RUN_CHARS:
                        yield _arrow(out)
                        out, held = [], 0
                    now = _Conversation(conv_id, tok)
                now.add(role, text)
        if now is not None:
            out.append(now.row())
        if out:
            yield _arrow(out)

    return dealt.mapInArrow(stream, SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text and the mask say when they are read back."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, text, spans in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = parse(text)
                every = hashlib.sha256()
                for role, said in turns:
                    every.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append({"conv_id": conv_id, "n_turns": len(turns), "turns_sha256": every.hexdigest(), "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), "formatted_chars": len(text)})
            schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
