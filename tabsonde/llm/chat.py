"""Chat formatting of typed content parts, with loss spans and a reader of the format."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
PARTS = "array<struct<kind:string,text:string,uri:string,units:long>>"
#: Tokens that one unit of an attachment expands to: a tile of an image, a second of sound, a page of a document.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 400}
TURN = ("formatted string, loss_start long, loss_end long, attachments array<struct<position:int,kind:string,"
        "uri:string,tokens:long>>, expanded_tokens long")
_seen, _made = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_turn = re.compile(re.escape(START) + r"(.*?)\n(.*)" + re.escape(END) + r"\n", re.DOTALL)
_place = re.compile(r"<\|(image|audio|document|attachment)_(\d+)\|>")


def escape(text: str) -> str:
    """No control string remains: every "<|", also one escaped before, gets one more backslash inside."""
    return _seen.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _made.sub(r"<\1|", text)


class Visitor:
    """Flattens content parts in order: texts escaped, attachments as numbered placeholders."""

    def __init__(self, unit_tokens: dict[str, int]):
        self.unit_tokens, self.out, self.attachments, self.tokens = unit_tokens, [], [], 0

    def visit(self, part: dict | None) -> None:
        if part is None:
            return
        kind = part.get("kind") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)
        if part.get("text"):  # a document may come with its extracted text
            self.visit_text(part)

    def visit_other(self, part: dict) -> None:
        self._attach("attachment", part)

    def _attach(self, kind: str, part: dict) -> None:
        tokens = self.unit_tokens.get(kind, 1) * max(1, part.get("units") or 1)
        position = len(self.attachments)
        self.out.append(f"<|{kind}_{position}|>")
        self.attachments.append({"position": position, "kind": part.get("kind"), "uri": part.get("uri"), "tokens": tokens})
        self.tokens += tokens


def format_turn(role: str | None, parts: list, unit_tokens: dict[str, int]) -> tuple[str, int, int, list, int]:
    """(formatted turn, start and end of its content in code points, attachments, expanded tokens)."""
    visitor = Visitor(unit_tokens)
    for part in parts:
        visitor.visit(part)
    content = "".join(visitor.out)
    head = START + escape(role or "").replace("\n", LINE) + "\n"
    return head + content + END + "\n", len(head), len(head) + len(content), visitor.attachments, visitor.tokens


def read_turn(formatted: str) -> tuple[str, list[tuple[str, str]]]:
    """(role, [(kind, text or attachment position)]) of one formatted turn."""
    found = _turn.fullmatch(formatted)
    if not found:
        raise ValueError("not a formatted turn")
    role = unescape(found[1].replace(LINE, "\n"))
    parts, at = [], 0
    for place in _place.finditer(found[2]):
        parts.append(("text", unescape(found[2][at:place.start()])))
        parts.append((place[1], place[2]))
        at = place.end()
    parts.append(("text", unescape(found[2][at:])))
    return role, [p for p in parts if p[0] != "text" or p[1]]


def format_turns(turns: DataFrame, content: str = "text", trained: tuple[str, ...] = ("assistant",),
                 unit_tokens: dict[str, int] | None = None) -> DataFrame:
    """Format each turn by itself; a conversation is its turns' strings in order.

    turns has conv_id, turn, role and a content column: a string, or an array of parts (PARTS) whose kinds are text,
    image, audio, document or anything else. Returns conv_id, turn, role, the columns of TURN, and loss: whether
    the role is trained. loss_start and loss_end delimit the content in `formatted`, in code points.

    A null content or text is empty, a null role the empty role. Rows that repeat are formatted each. Nothing is
    grouped here, so a conversation with a third of all rows is spread like any other rows.
    """
    costs = unit_tokens or UNIT_TOKENS
    plain = isinstance(turns.schema[content].dataType, T.StringType)

    def run(batches):
        for batch in batches:
            got = [format_turn(role, [{"kind": "text", "text": c}] if plain else (c or []), costs)
                   for role, c in zip(batch.column("role").to_pylist(), batch.column("_content").to_pylist())]
            columns = list(zip(*got)) if got else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), batch.column("role"),
                 pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                 pa.array(columns[3], pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()),
                                                          ("uri", pa.string()), ("tokens", pa.int64())]))),
                 pa.array(columns[4], pa.int64())],
                names=["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"])

    kinds = ", ".join(f"{c} {turns.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn", "role"))
    out = turns.select("conv_id", "turn", "role", F.col(content).alias("_content")).mapInArrow(run, f"{kinds}, {TURN}")
    return out.withColumn("loss", F.coalesce(F.col("role").isin(*trained), F.lit(False)))


def digests(formatted: DataFrame) -> DataFrame:
    """Read formatted turns back: one row per conversation with n_turns, turns_sha256 (role, line feed, text, line
    feed per turn), loss_chars and loss_sha256 (unescaped text under the loss mask) and formatted_chars.

    Turns arrive sorted and are hashed one after another, so a conversation of any length takes constant memory.
    Equal turn numbers are ordered by their strings. Null conv_ids are one conversation.
    """
    def run(batches):
        now, state, done = None, None, []

        def close():
            return (now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def table(rows):
            columns = list(zip(*rows))
            kinds = (key_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            key_kind = batch.schema.field("conv_id").type
            for key, text, loss, start, end in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "formatted", "loss", "loss_start", "loss_end"))):
                if now is None or now[0] != key:
                    if now is not None:
                        done.append(close())
                    now, state = (key,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, parts = read_turn(text)
                said = "".join(p[1] for p in parts if p[0] == "text")
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                if loss:
                    # what the mask covers, cut out of the formatted string itself
                    masked = unescape(_place.sub("", text[start:end]))
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(text)
            if len(done) >= 1000:
                yield table(done)
                done = []
        if now is not None:
            done.append(close())
        if done:
            yield table(done)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema["conv_id"].dataType.simpleString()
    rows = formatted.select("conv_id", "turn", "formatted", "loss", "loss_start", "loss_end")
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
            .mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                             "loss_sha256 string, formatted_chars long"))
