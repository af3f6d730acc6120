"""Chat formatting at the level of tokens.

Every turn's role and text are encoded by themselves; the reserved ids that
mark turns are spliced in between as numbers and are never the product of
encoding text. A ``<|`` in a text or role gets a backslash between its two
characters (one more if backslashes are there already), so no control string
occurs in a content; taking one away restores the text.

    <|im_start|>role\\n text <|im_end|>\\n

The loss mask comes from the segments' lengths: +1 where an assistant's text
begins, -1 where it ends, and prefix sums of those over the turn's ids.

Turns are encoded where they lie, in parallel, a long conversation's too. Then
they are sorted within their conversation and strung together: a conversation
is rows of at most ``PART`` ids, numbered from 0, however its turns lie in them.
Reading back knows only these ids and masks. It streams a conversation's parts,
finds the turns by the control ids, and holds a part at a time, a role and the
running digests, however long a turn or a conversation is.

Long runs of white space are encoded as the single piece that they are: the
tokenizer's pattern would back off through them step by step.

Defined cases: a null text or role is empty; bytes that are not valid UTF-8
count as replacement characters; turns that share a number are ordered by
role, then text; rows without a conversation or turn are of the conversation
null or come first; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, text_of

#: The control strings of the template and their ids, beyond the vocabulary and its end-of-text id.
START, END = "<|im_start|>", "<|im_end|>"
START_ID, END_ID = 50257, 50258
_OPEN = re.compile(r"<(\\*)\|")
_CLOSED = re.compile(r"<\\(\\*)\|")
#: The same in bytes, and what may become one with the bytes that follow.
_CLOSED_BYTES, _BEGUN = re.compile(rb"<\\(\\*)\|"), re.compile(rb"<\\*\Z")
#: The white space of the tokenizer's pattern. From this length on a run is encoded by itself.
_WHITE = "\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG = re.compile(f"[{_WHITE}]{{2000,}}")
#: Ids in a row of a formatted conversation, at most.
PART = 1 << 16


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(path: str):
    """The ids of a text, as the tokenizer's pattern and merges give them."""
    tokens = encoding(path)

    def encode(text: str) -> list[int]:
        out, at = [], 0
        for run in _LONG.finditer(text):
            # the pattern leaves the last blank before a word to what follows
            end = run.end() - (run.end() < len(text))
            out += tokens.encode_ordinary(text[at : run.start()])
            out += tokens._encode_single_piece(text[run.start() : end])
            at = end
        return out + tokens.encode_ordinary(text[at:]) if at else tokens.encode_ordinary(text)

    return encode


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _CLOSED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As texts; a line feed, which ends the role, as backslash n, and backslashes doubled."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text, ids, mask) for each turn: ids as little-endian unsigned 32-bit values, a mask byte for each id.

    In order of turn, role and text the rows of a conversation follow one another as its sequence.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        tail = encode("\n")
        for batch in batches:
            ids_out, mask_out = [], []
            for role, text in zip(*(batch.column(k).cast(pa.binary()) for k in (2, 3))):
                role, text = (v.as_py().decode("utf-8", "replace") for v in (role, text))
                segments = [([START_ID], 0), (encode(escape_role(role) + "\n"), 0), (encode(escape(text)), role == "assistant"), ([END_ID], 0), (tail, 0)]
                ends = np.cumsum([len(s) for s, _ in segments])
                step = np.zeros(ends[-1] + 1, np.int8)
                for (s, on), end in zip(segments, ends):
                    step[end - len(s)] += on
                    step[end] -= on
                ids_out.append(np.concatenate([np.array(s, "<u4") for s, _ in segments]).tobytes())
                mask_out.append(np.cumsum(step[:-1], dtype=np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(ids_out, pa.binary()), pa.array(mask_out, pa.binary())], names=["conv_id", "turn", "role", "text", "ids", "mask"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, ids binary, mask binary")


_SEQUENCE = "conv_id long, part long, ids binary, mask binary"


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, part, ids, mask): each conversation's turns strung together, in rows of at most ``PART`` ids."""
    names = [x.split()[0] for x in _SEQUENCE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, ids, mask = None, None, bytearray(), bytearray()
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal rows, size
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
            rows, size = [], 0
            return pa.RecordBatch.from_arrays(cols, names=names)

        def cut(least: int) -> None:
            nonlocal part, size
            while len(mask) >= least and mask:
                rows.append((now, part, bytes(ids[: 4 * PART]), bytes(mask[:PART])))
                size += len(rows[-1][2])
                del ids[: 4 * PART], mask[:PART]
                part += 1

        for batch in batches:
            for conv, raw, raw_mask in zip(*(batch.column(k) for k in range(3))):
                if part is None or conv.as_py() != now:
                    cut(1)
                    now, part = conv.as_py(), 0
                ids += raw.as_py()
                mask += raw_mask.as_py()
                cut(PART)
                if size >= 16 * PART or len(rows) >= 1000:
                    yield out()
        cut(1)
        if rows:
            yield out()

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "ids", "mask").mapInArrow(run, _SEQUENCE)


class _Plain:
    """Takes escapes out of a stream of bytes."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> bytes:
        data = self.held + data
        begun = _BEGUN.search(data)
        data, self.held = (data[: begun.start()], data[begun.start() :]) if begun else (data, b"")
        return _CLOSED_BYTES.sub(rb"<\1|", data)

    def rest(self) -> bytes:
        data, self.held = self.held, b""
        return data


def _points(data: bytes) -> int:
    """Code points of UTF-8: every byte but continuation bytes starts one."""
    return int(np.count_nonzero(np.frombuffer(data, np.int8) >= -64))


class _Reading:
    """What the ids and masks of one conversation, in order, say."""

    def __init__(self, decode) -> None:
        self.decode = decode
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.formatted = 0
        self.inside, self.role = False, None
        self.text, self.said = _Plain(), _Plain()

    def feed(self, ids: np.ndarray, mask: np.ndarray) -> None:
        edges = np.flatnonzero((ids == START_ID) | (ids == END_ID) | np.concatenate([[False], mask[1:] != mask[:-1]]))
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)]):
            if a == b:
                continue
            if ids[a] in (START_ID, END_ID):
                self.control(ids[a] == START_ID)
                a += 1
            if a < b:
                self.content(self.decode(ids[a:b].tolist()), bool(mask[a]))

    def control(self, start: bool) -> None:
        if start == self.inside:
            raise ValueError("a turn begins within a turn, or ends twice")
        self.inside = start
        self.formatted += len(START if start else END)
        if start:
            self.role = b""
        else:
            if self.role is not None:
                raise ValueError("a turn without a role")
            self.turns.update(self.text.rest() + b"\n")
            self.spoken(self.said.rest())
            self.n += 1

    def spoken(self, data: bytes) -> None:
        self.loss.update(data)
        self.loss_chars += _points(data)

    def content(self, data: bytes, learned: bool) -> None:
        self.formatted += _points(data)
        if learned:
            self.spoken(self.said.feed(data))
        if not self.inside:
            return
        if self.role is not None:
            self.role, found, data = (self.role + data).partition(b"\n")
            if not found:
                return
            self.turns.update(unescape_role(self.role.decode()).encode() + b"\n")
            self.role = None
        self.turns.update(self.text.feed(data))

    def row(self) -> tuple:
        if self.inside:
            raise ValueError("a conversation ends within a turn")
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted


def read_back(sequences: DataFrame, path: str | None = None) -> DataFrame:
    """From the ids and masks alone, for each conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    path = path or vocabulary_path()
    fields = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoding(path).decode_bytes
        now, reading, rows = None, None, []
        for batch in batches:
            for conv, raw, raw_mask in zip(*(batch.column(k) for k in range(3))):
                if reading is None or conv.as_py() != now:
                    if reading:
                        rows.append((now, *reading.row()))
                    now, reading = conv.as_py(), _Reading(decode)
                reading.feed(np.frombuffer(raw.as_py(), "<u4"), np.frombuffer(raw_mask.as_py(), np.int8).astype(bool))
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows = []
        if reading:
            rows.append((now, *reading.row()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    ordered = sequences.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.select("conv_id", "ids", "mask").mapInArrow(run, fields)


def chat_report(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """Formats all conversations, writes the sequences to the shared storage and reads them back."""
    return read_back(materialise(conversations_of(format_turns(conversations, path)), "chat"), path)
