"""Chat formatting from event logs: conversations are rebuilt from streamed deltas, edits and regenerations, then rendered with a loss mask.

An event is (conv_id, message, seq, kind, role, text), `message` being the place of the message that it concerns:

- `message` opens a message with a role and its first text; a further one of the same place opens another message there
- `delta` appends text to the message opened last at its place (and opens one without a role where there is none)
- `edit` replaces the text of that message by its own
- `regenerate` replaces its text too, and takes back all that was said at later places before (smaller seq)
- `delete` takes the message away

Logs are dealt by conversation, sorted by message and sequence, and folded as they stream by: what a task holds is one message, and how far the
conversation's regenerations reach. Conversations of more than `segment` messages are dealt in segments; a segment gets the reach of the earlier ones beforehand.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetworth.llm._common import maybe_in

KINDS = ("message", "delta", "edit", "regenerate", "delete")
_EVENTS = ("conv_id", "segment", "kind", "role", "text", "seq", "message")
_FIRST = -(2**63)


@dataclass(frozen=True)
class Template:
    """Marks of a turn: `begin` role newline text `end`. Control strings in roles and texts, and the escape character itself, are escaped by that character."""

    begin: str = "<turn>"
    end: str = "</turn>\n"
    escape: str = "\\"

    def __post_init__(self) -> None:
        stop = self.end.rstrip("\n")
        if len(self.escape) != 1 or self.escape in self.begin + self.end + "\n" or not self.begin or not stop:
            raise ValueError("a template needs marks, and an escape of one character that is not part of them")
        if any(stop[:i] == stop[-i:] for i in range(1, len(stop))):
            raise ValueError("the end mark must not begin as it ends, or a text's last character could seem part of it")

    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.end.rstrip("\n"))

    def escaped(self, text: str) -> str:
        """Every control string gets an escape before its first character, wherever one begins (they may overlap)."""
        if self.escape in text:
            text = text.replace(self.escape, self.escape * 2)
        if any(c in text for c in self.controls()):
            text = re.sub(f"(?={'|'.join(map(re.escape, self.controls()))})", lambda _: self.escape, text)
        return text

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.DOTALL) if self.escape in text else text

    def role(self, role: str) -> str:
        return self.escaped(role).replace("\n", self.escape + "\n")

    def turns(self) -> re.Pattern:
        """One rendered turn: its role and text, both escaped."""
        e, stop = re.escape(self.escape), re.escape(self.end.rstrip("\n"))
        first = re.escape(self.end[0])
        role = rf"((?:[^{e}\n]|{e}.)*+)"
        text = rf"((?:[^{e}{first}]++|{e}.|(?!{stop}){first})*+)"
        return re.compile(rf"{re.escape(self.begin)}{role}\n{text}{re.escape(self.end)}", re.DOTALL)


def _messages(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Fold sorted events into final messages (conv_id, segment, role, text)."""
    key, place, reach, below = None, None, _FIRST, _FIRST
    role, pieces = None, None

    def closed() -> Iterator[tuple]:
        if pieces is not None:
            yield (*key, role, "".join(pieces))

    for conv, segment, kind, said_by, text, seq, message in rows:
        if key != (conv, segment) or message != place:
            yield from closed()
            role = pieces = None
            # `below` is what regenerations at smaller places reach, `reach` what those at this place do too.
            below = reach if key == (conv, segment) else _FIRST
            reach = below
            key, place = (conv, segment), message
        at = _FIRST if seq is None else seq
        if kind == "carried":
            below = reach = max(reach, at)
            continue
        if at < below or kind not in KINDS:
            continue
        text = text or ""
        if kind == "message":
            yield from closed()
            role, pieces = said_by, [text]
        elif kind == "delete":
            role = pieces = None
        elif kind == "delta":
            if pieces is None:
                role, pieces = said_by, []
            pieces.append(text)
        else:
            role, pieces = (said_by if pieces is None else role), [text]
            if kind == "regenerate":
                reach = max(reach, at)
    yield from closed()


def _rendered(template: Template, trained: str, most: int):
    """Messages to parts of at most about `most` characters, with the spans of the texts to train on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out, size = [], 0
        key, part, pieces, at, loss = None, 0, [], 0, []

        def packed() -> pa.RecordBatch:
            spans = pa.array([r[4] for r in out], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            plain = zip(*[r[:4] for r in out], strict=True)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.string())
            names = ("conv_id", "segment", "part", "text")
            return pa.record_batch({n: pa.array(v, t) for n, v, t in zip(names, plain, types, strict=True)} | {"loss": spans})

        for conv, segment, role, text in _messages(rows()):
            if pieces and (key != (conv, segment) or at >= most):
                out.append((*key, part, "".join(pieces), loss))
                size += at
                part, pieces, at, loss = part + 1, [], 0, []
                if size >= most:
                    yield packed()
                    out, size = [], 0
            if key != (conv, segment):
                key, part = (conv, segment), 0
            head, body = f"{template.begin}{template.role(role or '')}\n", template.escaped(text)
            if role == trained:
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            pieces += [head, body, template.end]
            at += len(head) + len(body) + len(template.end)
        if pieces:
            out.append((*key, part, "".join(pieces), loss))
        if out:
            yield packed()

    return run


def _segment(message: Column, segment: int) -> Column:
    return F.coalesce(F.floor(message / segment), F.lit(_FIRST))


def format_chats(events: DataFrame, template: Template = Template(), trained: str = "assistant", segment: int = 4096, part_chars: int = 1 << 22) -> DataFrame:
    """conv_id, segment, part, text, loss: the conversations of events(conv_id, message, seq, kind, role, text) as rendered text.

    A conversation is the concatenation of its parts by (segment, part); loss holds the spans [start, end) of each part's text, in code points, that a model is
    trained on: the texts of messages whose role is `trained`, without marks. Turns are never cut. Parts of a conversation's segment follow each other in one partition.

    Events of equal message and seq are taken by role, then text (nulls first). A null text is empty, a null role is the empty role, a null seq or message comes first, a
    null conv_id is a conversation of its own, events of other kinds are passed over; a conversation without messages, or with none left, and an empty table
    give no rows. Other columns are not read. One message's text has to fit in a task's memory, a conversation has not.
    """
    plain = _placed(events, segment)
    return _formatted(plain.unionByName(_carried(plain)), template, trained, part_chars)


def _placed(events: DataFrame, segment: int) -> DataFrame:
    plain = events.select(F.col("conv_id").cast("long"), F.col("message").cast("long"), F.col("seq").cast("long"), "kind", "role", "text")
    return plain.where(F.col("kind").isin(*KINDS)).withColumn("segment", _segment(F.col("message"), segment)).withColumn("own", F.lit(1))


def _carried(placed: DataFrame) -> DataFrame:
    """For each later segment of a conversation, an event that says how far regenerations of earlier ones reach."""
    ends = placed.groupBy("conv_id").agg(F.min("segment").alias("a"), F.max("segment").alias("z"), F.max(F.col("kind") == "regenerate").alias("some"))
    ends = ends.where("some and a < z").select(F.col("conv_id").alias("_long"))
    reach = placed.groupBy("conv_id", "segment").agg(F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("seq"))
    reach = reach.join(ends, F.col("conv_id").eqNullSafe(F.col("_long"))).drop("_long")
    earlier = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    none = {"message": F.lit(None).cast("long"), "kind": F.lit("carried"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "own": F.lit(0)}
    return reach.withColumn("seq", F.max("seq").over(earlier)).where("seq is not null").withColumns(none)


def _formatted(events: DataFrame, template: Template, trained: str, part_chars: int) -> DataFrame:
    order = ["conv_id", "segment", "own", "message", "seq", "role", "text"]
    dealt = events.repartition("conv_id", "segment").sortWithinPartitions(*order).select(*_EVENTS)
    return dealt.mapInArrow(_rendered(template, trained, part_chars), "conv_id long, segment long, part int, text string, loss array<struct<start:int,end:int>>")


def _read(template: Template):
    """What parts say, conversation by conversation, as they stream by in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, names = template.turns(), ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        out, seen, key = [], False, None

        def close() -> None:
            out.append((key, turns, said.hexdigest(), loss_chars, loss.hexdigest(), chars))

        for batch in batches:
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss")), strict=True):
                if not seen or conv != key:
                    if seen:
                        close()
                    seen, key, turns, loss_chars, chars = True, conv, 0, 0, 0
                    said, loss = hashlib.sha256(), hashlib.sha256()
                at = 0
                for m in iter(lambda: turn.match(text, at), None):  # noqa: B023
                    role, body = (template.unescaped(g) for g in m.groups())
                    said.update(f"{role}\n{body}\n".encode())
                    turns, at = turns + 1, m.end()
                if at != len(text):
                    raise ValueError("a part is not a sequence of turns")
                for span in spans:
                    under = template.unescaped(text[span["start"] : span["end"]])
                    loss.update(under.encode())
                    loss_chars += len(under)
                chars += len(text)
            if len(out) >= 10_000:
                yield pa.record_batch({n: pa.array(v, t) for n, v, t in zip(names, zip(*out, strict=True), types, strict=True)})
                out = []
        if seen:
            close()
        if out:
            yield pa.record_batch({n: pa.array(v, t) for n, v, t in zip(names, zip(*out, strict=True), types, strict=True)})

    return run


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(parts: DataFrame, template: Template = Template(), in_order: bool = False) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of format_chats(), read from the rendered text and its spans.

    turns_sha256 is over role, newline, text, newline of each turn, loss_sha256 over the texts to train on, both unescaped and streamed. With in_order the
    caller vouches that each conversation's parts follow each other in one partition, as they do where no conversation has a second segment.
    A part that isn't a sequence of turns raises an error; no parts, no rows.
    """
    if not in_order:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "part")
    return parts.select("conv_id", "text", "loss").mapInArrow(_read(template), _READ)


def digests(events: DataFrame, template: Template = Template(), segment: int = 4096) -> DataFrame:
    """read_back() of format_chats(). Conversations of a single segment are read where they are rendered; those that may have more are dealt once more."""
    placed = _placed(events, segment)
    several = placed.groupBy("conv_id").agg(F.min("segment").alias("a"), F.max("segment").alias("z")).where("conv_id is not null and a < z")
    marked = maybe_in(placed, several.select("conv_id"), "conv_id")
    short = _formatted(marked.where("not _maybe and conv_id is not null").drop("_maybe"), template, "assistant", 1 << 22)
    long = marked.where("_maybe or conv_id is null").drop("_maybe")
    long = _formatted(long.unionByName(_carried(long)), template, "assistant", 1 << 22)
    return read_back(short, template, in_order=True).unionByName(read_back(long, template))
