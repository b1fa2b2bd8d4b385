r"""Chat formatting with a grammar round trip.

Template: a turn is an opening mark, the text and a closing mark.
``[INST]text[/INST]`` is a user turn, ``<s>text</s>`` an assistant turn,
``<<SYS>>text<</SYS>>`` a system turn, ``<role:name>text</role>`` any other
(bytes of the name outside ``A-Za-z0-9_-`` as ``%XX``).

Grammar of a body: a mark after an odd number of backslashes is text, a
mark after an even number is a mark, and half of the backslashes belong to
the text; backslashes elsewhere are ordinary. A turn is first rendered as
it is and parsed again. Where the parser does not recover it, because its
text has a mark or ends in backslashes, the conflicting places are escaped,
and the result must parse back identically.

A conversation is the concatenation of its turns' pieces. Pieces are
rendered one by one, and conversations are read back by streaming the
sorted pieces through the parser, so memory does not grow with the number
of turns of a conversation.

Defined results: a null text is empty, a null role is the role ""; turns
with equal numbers are ordered by role and text; repeated rows are turns of
their own; rows with a null conv_id form one conversation; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
_ROLE = r"<role:[A-Za-z0-9_%-]*>"
_ANY = r"<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|</role>|" + _ROLE
_MARK = re.compile(rf"(?<!\\)(\\*)({_ANY})")
_OPEN = re.compile(rf"\[INST\]|<s>|<<SYS>>|{_ROLE}")


def marks(role: str) -> tuple[str, str]:
    if role in MARKS:
        return MARKS[role]
    name = "".join(chr(b) if re.match(r"[A-Za-z0-9_-]", chr(b)) and b < 128 else f"%{b:02X}" for b in role.encode())
    return f"<role:{name}>", "</role>"


def _role(mark: str) -> tuple[str, str]:
    for role, (a, b) in MARKS.items():
        if mark == a:
            return role, b
    raw = re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), mark[len("<role:"):-1].encode())
    return raw.decode(), "</role>"


def escape(text: str) -> str:
    out = _MARK.sub(lambda m: "\\" * (2 * len(m[1]) + 1) + m[2], text)
    return out + "\\" * (len(out) - len(out.rstrip("\\")))


def parse_turn(text: str, at: int = 0) -> tuple[str, str, int] | None:
    """(role, text, end) of the turn that starts at ``at``; None if it is
    not complete there."""
    m = _OPEN.match(text, at)
    if not m:
        return None
    role, close = _role(m[0])
    out, last = [], m.end()
    for m in _MARK.finditer(text, last):
        # finditer looks behind ``last``; the opening mark never ends in a backslash
        out += [text[last:m.start()], "\\" * (len(m[1]) // 2)]
        last = m.end()
        if len(m[1]) % 2:
            out.append(m[2])
        else:
            return (role, "".join(out), last) if m[2] == close else None
    return None


def unescape(body: str) -> str:
    """The text of an escaped or unescaped body, as the grammar reads it."""
    return parse_turn(f"<s>{body}</s>")[1]


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A turn's piece and where the text is in it."""
    role, text = role or "", text or ""
    a, b = marks(role)
    for body in (text, escape(text)):
        piece = a + body + b
        if parse_turn(piece) == (role, text, len(piece)):
            return piece, len(a), len(a) + len(body)
    raise ValueError(f"a turn does not survive the round trip: {piece[:200]!r}")


def format_turns(conversations: DataFrame) -> DataFrame:
    """The formatted conversations as pieces: conv_id, turn, role, text_order
    (breaks ties), piece, loss_start, loss_end (code points in the piece
    under the loss mask; both 0 outside assistant turns)."""

    def run(batches):
        for b in batches:
            roles, texts = b.column("role").to_pylist(), b.column("text").to_pylist()
            got = [render(r, t) for r, t in zip(roles, texts)]
            loss = [(s, e) if r == "assistant" else (0, 0) for r, (_, s, e) in zip(roles, got)]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), b.column("role"), pa.array([g[0] for g in got], pa.string()),
                 pa.array([x[0] for x in loss], pa.int64()), pa.array([x[1] for x in loss], pa.int64())],
                names=["conv_id", "turn", "role", "piece", "loss_start", "loss_end"])

    cols = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                "role", "text")
    return cols.mapInArrow(run, "conv_id long, turn long, role string, piece string, loss_start long, loss_end long")


class _Reader:
    """Reads a conversation's pieces back, keeping digests only."""

    def __init__(self):
        self.rest, self.turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, start: int, end: int):
        self.chars += len(piece)
        text, at = self.rest + piece, 0
        while at < len(text) and (got := parse_turn(text, at)):
            role, body, at = got
            self.turns += 1
            self.all.update(f"{role}\n{body}\n".encode())
        self.rest = text[at:]
        if end > start:
            said = unescape(piece[start:end])
            self.loss_chars += len(said)
            self.loss.update(said.encode())

    def row(self, key):
        if self.rest:
            raise ValueError(f"conversation {key} does not parse: {self.rest[:200]!r}")
        return key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(pieces: DataFrame) -> DataFrame:
    """What the parser recovers from formatted pieces, per conversation:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        key, reader = None, None
        for b in batches:
            rows = []
            for k, piece, s, e in zip(*(b.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end"))):
                if reader is None or k != key:
                    if reader:
                        rows.append(reader.row(key))
                    key, reader = k, _Reader()
                reader.feed(piece, s, e)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)
        if reader:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, reader.row(key)))], schema=schema)

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "piece")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                   "loss_sha256 string, formatted_chars long")


def formatted(pieces: DataFrame) -> DataFrame:
    """Each conversation's whole formatted text, for conversations that fit
    a row: conv_id, formatted."""
    return (pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "piece"))).alias("t"))
            .select("conv_id", F.array_join(F.col("t.piece"), "").alias("formatted")))
