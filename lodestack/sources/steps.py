"""What converters are given and give back: the task, its parts by name, the collector of parts, and routing."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

OPTIONS = {"wantOcr": True, "wantSplitByPage": False, "languageCode": "en"}
_PART = re.compile(r"([0-9]+)(\.json|\.blob|\.txt|-thumbnail\.(?:png|jpg)|\.inherit-blob)|(progress|done|error|canceled)")


def route(content_type: str, want_ocr: bool = False, canceled: bool = False, known: Iterable[str] = ()) -> str:
    """Name of a file's step: cancelled files first; PDF by whether its text is to be recognised; ``text/*``; else by what is known."""
    if canceled:
        return "Canceled"
    if content_type == "application/pdf":
        return "PdfOcr" if want_ocr else "Pdf"
    return content_type if content_type in known else "Text" if content_type.startswith("text/") else "Unhandled"


def task_payload(file: dict, url: str) -> dict:
    """What a converter is told of a file: id, url, filename, type, language, metadata, options and its blob."""
    option = lambda name: file.get(name, OPTIONS[name])
    blob = {"url": file.get("blob_url") or f"{url}/blob", "nBytes": file.get("n_bytes"), "sha1": file.get("sha1")}
    return {"id": file["id"], "url": url, "filename": file["filename"], "contentType": file["content_type"], "languageCode": option("languageCode"), "metadata": json.loads(file.get("metadata_json") or "{}"), "wantOcr": option("wantOcr"), "wantSplitByPage": option("wantSplitByPage"), "blob": blob}


@dataclass(frozen=True)
class Part:
    """kind: header, blob, inherit, text, thumbnail, progress, done, error or canceled; index: that of the child."""

    kind: str
    index: int = 0
    data: bytes = b""


def named_part(name: str, data: bytes = b"") -> Part | None:
    """A part by its name in the converter's answer: ``0.json``, ``0.blob``, ``0.txt``, ``0-thumbnail.png``; None for other names."""
    m = _PART.fullmatch(name)
    if not m:
        return None
    if m[3]:
        return Part(m[3], data=data)
    kind = {".json": "header", ".blob": "blob", ".txt": "text", ".inherit-blob": "inherit"}.get(m[2], "thumbnail")
    return Part(kind, int(m[1]), data)


@dataclass
class Child:
    index: int
    header: dict
    blob: bytes | None = None
    inherits: bool = False
    text: str | None = None
    thumbnail: bytes | None = None

    def processed(self) -> bool:
        """Whether the child needs no step of its own: a PDF with blob and thumbnail, from which nothing more is wanted."""
        h = self.header
        return h.get("contentType") == "application/pdf" and not h.get("wantOcr") and not h.get("wantSplitByPage") and self.thumbnail is not None and (self.blob is not None or self.inherits)


@dataclass
class Collector:
    """Gathers a converter's parts into children; parts of a second run, and whatever follows the end, are ignored.

    ``error`` is set where the converter failed or broke the rules; the child that was open then doesn't count.
    """

    name: str = "converter"
    children: list[Child] = field(default_factory=list)
    error: str | None = None
    progress: float = 0.0
    ended: bool = False

    def add(self, part: Part) -> None:
        if self.ended:
            return
        open_ = self.children[-1] if self.children else None
        if part.kind == "progress":
            self.progress = max(0.0, min(1.0, float(part.data or 0)))
        elif part.kind in ("done", "error", "canceled"):
            self._end(part, open_)
        elif part.kind == "header":
            self._header(part, open_)
        elif open_ is None or part.index > open_.index:
            self._broken(f"unexpected part {part.kind} {part.index}")
        elif part.index == open_.index:
            self._attach(part, open_)

    def _header(self, part: Part, open_: Child | None) -> None:
        last = -1 if open_ is None else open_.index
        if part.index <= last:
            return
        if part.index > last + 1:
            self._broken(f"unexpected part header {part.index}")
        elif self._complete(open_):
            self.children.append(Child(part.index, json.loads(part.data or b"{}")))

    def _attach(self, part: Part, child: Child) -> None:
        if part.kind == "inherit":
            if child.index:
                self._broken("only the first child can inherit its parent's blob")
            child.inherits = True
        elif part.kind == "blob":
            child.blob = part.data
        elif part.kind == "text":
            child.text = part.data.decode("utf-8", "replace")
        else:
            child.thumbnail = part.data

    def _complete(self, child: Child | None) -> bool:
        if child is not None and child.blob is None and not child.inherits:
            self._broken("tried to write child without blob data")
            return False
        return True

    def _end(self, part: Part, open_: Child | None) -> None:
        if part.kind == "done":
            self.progress = 1.0
            if self._complete(open_):
                self.ended = True
            return
        self._fail("canceled" if part.kind == "canceled" else part.data.decode("utf-8", "replace"))

    def _broken(self, message: str) -> None:
        self._fail(f"logic error in {self.name}: {message}")

    def _fail(self, message: str) -> None:
        self.error, self.ended = message, True
        del self.children[-1:]


def collected(parts: Iterable[Part], name: str = "converter") -> Collector:
    out = Collector(name)
    for part in parts:
        out.add(part)
    if not out.ended:
        out._broken("it ended without a last part")
    return out


def as_children(collector: Collector, parent: dict) -> list[dict]:
    """Children as a converter registered with ``plugins.register_converter`` returns them."""
    out = []
    for c in collector.children:
        content = bytes(parent["content"]) if c.inherits else c.blob or b""
        metadata = json.dumps(c.header["metadata"]) if "metadata" in c.header else parent.get("metadata_json")
        child = {"filename": c.header.get("filename"), "content_type": c.header.get("contentType"), "content": content, "metadata_json": metadata}
        out.append(child | ({"text": c.text} if c.text is not None else {}) | {"processed": c.processed()})
    return out
