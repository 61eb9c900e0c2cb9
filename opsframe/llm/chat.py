"""Chat formatting with typed content parts and a loss mask.

A turn is `<s>` role newline content `</s>` newline. A visitor flattens the parts of a turn in order:
text is escaped, an image, audio clip or document becomes a placeholder, its attachment is recorded
with the tokens that it will take once expanded.

Escaping is reversible: a control string inside a text gets a backslash after its first character,
and a control string that already has backslashes there gets one more. So no text holds a control
string, and taking one backslash away from each match gives the text back.

A conversation is read as a sorted stream and written as one row per turn with its place in the
conversation, so a conversation of any length fits in memory; all its turns, in order, are its text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The control strings that a text must not hold.
BOS, EOS = "<s>", "</s>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROL = [BOS, EOS, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", *PLACEHOLDERS.values()]

#: Tokens of a placeholder: a patch of PATCH x PATCH pixels (or IMAGE_TOKENS without a size), a second of audio, a page.
PATCH, IMAGE_TOKENS, AUDIO_TOKENS, PAGE_TOKENS = 14, 576, 25, 512

_RAW = re.compile("|".join(rf"{re.escape(c[0])}(\\*){re.escape(c[1:])}" for c in CONTROL))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\(\\*){re.escape(c[1:])}" for c in CONTROL))

SEGMENTS = (
    "conv_id long, segment long, role string, text string, char_start long, char_len long, loss_start long, loss_len long, "
    "expanded_tokens long, attachments array<struct<kind: string, ref: string, position: int, char_at: long, tokens: long>>"
)
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _RAW.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def _role_out(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _role_in(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


@dataclass
class Flattener:
    """Visits content parts in order: {"type": text|image|audio|document, ...}; an unknown type is an error."""

    out: list[str] = field(default_factory=list)
    chars: int = 0
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.unknown)(part)

    def unknown(self, part: dict) -> None:
        raise ValueError(f"unknown content part {part.get('type')!r}")

    def add(self, text: str) -> None:
        self.out.append(text)
        self.chars += len(text)

    def visit_text(self, part: dict) -> None:
        self.add(escape(part.get("text") or ""))

    def attach(self, part: dict, tokens: int) -> None:
        kind = part["type"]
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "position": len(self.attachments), "char_at": self.chars, "tokens": int(tokens)})
        self.add(PLACEHOLDERS[kind])

    def visit_image(self, part: dict) -> None:
        w, h = part.get("width"), part.get("height")
        self.attach(part, -(-int(w) // PATCH) * -(-int(h) // PATCH) if w and h else IMAGE_TOKENS)

    def visit_audio(self, part: dict) -> None:
        self.attach(part, -(-float(part.get("seconds") or 0) * AUDIO_TOKENS // 1))

    def visit_document(self, part: dict) -> None:
        self.attach(part, int(part.get("pages") or 1) * PAGE_TOKENS)


def format_conversations(rows: DataFrame, parts_col: str | None = None, trained_role: str = "assistant") -> DataFrame:
    """rows (conv_id, turn, role, text) to a row per turn, see SEGMENTS; offsets are code points in the conversation.

    parts_col names a column with a JSON list of content parts, used where it isn't null; else the text
    is the only part. Null texts and roles count as empty. Turns sort by turn, nulls first, ties by role
    and text; repeated rows are turns of their own; rows of a null conv_id are one conversation. Other
    columns are ignored. Loss spans cover the content of trained_role's turns, without its markers.
    The rows of a conversation come out together and in order.
    """
    small_batches(rows.sparkSession)
    c = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    flat = rows.select(*[F.col(k).cast(v) for k, v in c.items()], (F.col(parts_col) if parts_col else F.lit(None)).cast("string").alias("parts"))
    flat = flat.withColumns({k: F.coalesce(k, F.lit("")) for k in ("role", "text")})
    flat = flat.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "parts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, segment, at = object(), 0, 0
        for b in batches:
            out = []
            for conv, role, text, parts in zip(b["conv_id"], b["role"], b["text"], b["parts"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if conv != now:
                    now, segment, at = conv, 0, 0
                f = Flattener()
                head = f"{BOS}{_role_out(role)}\n"
                f.add(head)
                for p in json.loads(parts) if parts else [{"type": "text", "text": text}]:
                    f.visit(p)
                body = f.chars - len(head)
                f.add(f"{EOS}\n")
                for a in f.attachments:
                    a["char_at"] += at
                trained = role == trained_role
                out.append((conv, segment, role, "".join(f.out), at, f.chars, at + len(head) if trained else None, body if trained else 0, sum(a["tokens"] for a in f.attachments), f.attachments))
                segment, at = segment + 1, at + f.chars
            made = pd.DataFrame(out, columns=["conv_id", "segment", "role", "text", "char_start", "char_len", "loss_start", "loss_len", "expanded_tokens", "attachments"])
            yield made.astype({"conv_id": "Int64", "loss_start": "Int64"})

    return flat.mapInPandas(run, SEGMENTS)


def read_back(segments: DataFrame, ordered: bool = False) -> DataFrame:
    """Parse formatted conversations, see READ. Uses the text and the loss spans alone, a conversation's segments in order.

    turns_sha256 is of role, newline, text, newline per turn; loss_sha256 of the unescaped text under the mask.
    ordered: segments comes straight from format_conversations(), in its order; else, as after a write, it is put in order here.
    The digests need a conversation's turns one after another, so it is one task's work, but as a stream: a turn at a time is held.
    """
    if not ordered:
        segments = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict | None = None

        def done(s: dict) -> tuple:
            return s["conv"], s["turns"], s["all"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["formatted"]

        for b in batches:
            out = []
            for conv, text, start, loss, n in zip(b["conv_id"], b["text"], b["char_start"], b["loss_start"], b["loss_len"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or start == 0:
                    if state:
                        out.append(done(state))
                    state = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
                role, _, rest = text.removeprefix(BOS).partition("\n")
                if not (text.startswith(BOS) and rest.endswith(f"{EOS}\n")) or start != state["formatted"]:
                    raise ValueError(f"conversation {conv} is damaged at {start}")
                body = unescape(rest.removesuffix(f"{EOS}\n"))
                state["turns"] += 1
                state["all"].update(f"{_role_in(role)}\n{body}\n".encode())
                state["formatted"] += len(text)
                if not pd.isna(loss):
                    span = unescape(text[int(loss) - start : int(loss) - start + n])
                    state["chars"] += len(span)
                    state["loss"].update(span.encode())
            yield pd.DataFrame(out, columns=[x.split()[0] for x in READ.split(", ")]).astype({"conv_id": "Int64"})
        if state:
            yield pd.DataFrame([done(state)], columns=[x.split()[0] for x in READ.split(", ")]).astype({"conv_id": "Int64"})

    return segments.mapInPandas(run, READ)
