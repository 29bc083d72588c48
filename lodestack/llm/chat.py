"""Chat formatting of typed content parts.

A visitor flattens a message's text, image, audio and document parts into one string with ordered placeholders, records
each attachment's reference and place, and counts the tokens its placeholder stands for.  Control strings of the template
inside texts are escaped reversibly, so the formatted string can be read back exactly.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|turn|>", "<|end|>"
HOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Control strings that texts may not show: this template's and those of common chat templates.
CONTROL = [BEGIN, END, *HOLDERS.values(), "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_STARTS = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: str) -> str:
    r"""A backslash becomes ``\\``; after the first character of each control string comes ``\.``."""
    return _STARTS.sub(r"\1\\.", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\\" if m[1] == "\\" else "", text, flags=re.S)


@dataclass
class Flattener:
    """Visits parts in order; unknown kinds are taken as text."""

    out: list[str] = field(default_factory=list)
    held: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('kind')}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self.held.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        self._attach(part, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, math.ceil((part.get("seconds") or 0.0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part.get("pages") or 0) * PAGE_TOKENS)

    def settled(self) -> str:
        """Text gathered since the last attachment, escaped as one, so that no control string arises where parts meet."""
        text = escape("".join(self.held))
        self.held.clear()
        return text

    def _attach(self, part: dict, tokens: int) -> None:
        self.out += (self.settled(), HOLDERS[part["kind"]])
        self.attachments.append({"kind": part["kind"], "ref": part.get("ref"), "tokens": max(1, int(tokens))})


def format_turns(turns: list[tuple[str, list[dict]]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]], list[dict]]:
    """The formatted string, the loss mask (code-point spans of the learned role's contents) and the attachments in order."""
    out, at, mask, attachments = [], 0, [], []
    for n, (role, parts) in enumerate(turns):
        visitor = Flattener()
        for part in parts:
            visitor.visit(part)
        head, body = BEGIN + escape(role).replace("\n", "\\n") + "\n", "".join((*visitor.out, visitor.settled()))
        if role == learn:
            mask.append((at + len(head), at + len(head) + len(body)))
        attachments += [a | {"turn": n} for a in visitor.attachments]
        out.append(head + body + END)
        at += len(out[-1])
    return "".join(out), mask, attachments


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, content) of each turn of a formatted string; placeholders stay as they are."""
    turns = []
    for turn in formatted.split(END)[:-1]:
        role, _, body = turn.removeprefix(BEGIN).partition("\n")
        turns.append((re.sub(r"\\(.)", lambda m: {"\\": "\\", "n": "\n"}.get(m[1], ""), role), unescape(body)))
    return turns


def _format(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for conv, turns in zip(batch.conv_id, batch.turns, strict=True):
            text, mask, attachments = format_turns([(t["role"] or "", [dict(p.asDict() if hasattr(p, "asDict") else p) for p in t["parts"]]) for t in turns])
            rows.append((conv, text, [{"start": a, "stop": b} for a, b in mask], json.dumps(attachments), sum(a["tokens"] for a in attachments)))
        yield pd.DataFrame(rows, columns=["conv_id", "formatted", "loss_mask", "attachments", "attachment_tokens"])


def text_part(text: Column) -> Column:
    """A content-part array of one text."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none("string").alias("ref"), none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages")))


def format_conversations(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, parts array<PART>) -> conv_id, formatted, loss_mask, attachments (JSON), attachment_tokens.

    One row per conv_id (null is one too): a conversation's formatted string is one value, so its turns meet in one task,
    each about once its size.  Turns in order, null first; equal turns by role, then parts.  A null role is empty; null
    text is empty; a null part array is an empty message.  Further columns are ignored.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", "role", F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return grouped.mapInPandas(_format, "conv_id long, formatted string, loss_mask array<struct<start:int,stop:int>>, attachments string, attachment_tokens long")


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    digest = lambda s: sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        rows = []
        for conv, formatted, mask, tokens in zip(batch.conv_id, batch.formatted, batch.loss_mask, batch.attachment_tokens, strict=True):
            turns = read_turns(formatted)
            learned = "".join(unescape(formatted[m["start"] : m["stop"]]) for m in mask)
            rows.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), digest(learned), len(formatted), tokens))
        yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attachment_tokens"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from the formatted strings and masks alone."""
    return formatted.select("conv_id", "formatted", "loss_mask", "attachment_tokens").mapInPandas(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachment_tokens long")
