"""Highlights and snippets of search matches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html import escape

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import analyze, fold, query_terms, utf8_offset, utf16_offset
from ..plans.ast import And, Fuzzy, Not, Or, Prefix, Proximity, Query, Regex

MOST_PASSAGES, MOST_SNIPPETS, SNIPPET_CHARS = 1000, 2, 80
_SENTENCE = regex.compile(r"[^.!?…\n]*(?:[.!?…]+|\n|$)\s*")


def _close(a: str, b: str, most: int) -> bool:
    """Edit distance with neighbour swaps of at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1] <= most


def matched_tokens(query: Query, tokens: list[tuple[str, int, int]]) -> set[int]:
    """Places of the tokens of a text that the query's positive leaves match; fields other than the text don't count."""
    if isinstance(query, (And, Or)):
        return set().union(*(matched_tokens(n, tokens) for n in query.nodes))
    if isinstance(query, (Not, Regex)) or not hasattr(query, "field") or query.field.kind not in ("all", "text"):
        return set()
    if isinstance(query, Fuzzy):
        most = min(2, 2 if query.distance is None else query.distance)
        return {i for i, (t, _, _) in enumerate(tokens) if _close(t, fold(query.text), most)}
    wanted = query_terms(query.text)
    if not wanted:
        return set()
    terms, out = [t for t, _, _ in tokens], set()
    if isinstance(query, Proximity):
        at = [[i for i, t in enumerate(terms) if t == w] for w in wanted]
        for first in at[0]:
            run = [first]
            for k, places in enumerate(at[1:], 1):
                fit = [p for p in places if p not in run and abs((p - k) - first) <= query.slop]
                if not fit:
                    break
                run.append(min(fit, key=lambda p: abs(p - k - first)))
            else:
                out.update(run)
        return out
    for i in range(len(terms) - len(wanted) + 1):
        last = terms[i + len(wanted) - 1]
        if terms[i : i + len(wanted) - 1] == wanted[:-1] and (last.startswith(wanted[-1]) if isinstance(query, Prefix) else last == wanted[-1]):
            out.update(range(i, i + len(wanted)))
    return out


def highlights(text: str, query: Query, utf16: bool = True) -> list[tuple[int, int]]:
    """Half-open spans of the matches, sorted; overlapping, touching and neighbouring-token spans of one phrase are merged."""
    tokens = analyze(text)
    spans: list[list[int]] = []
    for i in sorted(matched_tokens(query, tokens)):
        _, begin, end = tokens[i]
        if spans and begin <= spans[-1][1]:
            spans[-1][1] = max(end, spans[-1][1])
        else:
            spans.append([begin, end])
    spans = spans[:MOST_PASSAGES]
    if not utf16 or text.isascii():
        return [(a, b) for a, b in spans]
    out, at, unit = [], 0, 0  # one walk over the text, not one a span
    for a, b in spans:
        first = unit + utf16_offset(text[at:a], a - at)
        at, unit = b, first + utf16_offset(text[a:b], b - a)
        out.append((first, unit))
    return out


def sentences(text: str, most: int = SNIPPET_CHARS) -> Iterator[tuple[int, int]]:
    """Spans of sentences, long ones cut at white space into parts of at most ``most`` characters, if they have any."""
    for m in _SENTENCE.finditer(text):
        begin, end = m.span()
        while end - begin > most:
            cut = max(text.rfind(" ", begin + 1, begin + most), text.rfind("\n", begin + 1, begin + most))
            cut = begin + most if cut <= begin else cut + 1
            yield begin, cut
            begin = cut
        if end > begin:
            yield begin, end


def snippets(text: str, query: Query) -> list[dict]:
    """At most two passages with matches: begin, end and the highlights in them, in code points."""
    marks, out = highlights(text, query, utf16=False), []
    for begin, end in sentences(text):
        inside = [(max(a, begin), min(b, end)) for a, b in marks if a < end and b > begin]
        if inside:
            out.append({"begin": begin, "end": end, "highlights": inside})
        if len(out) == MOST_SNIPPETS:
            break
    return out


def snippet_html(text: str, found: list[dict]) -> str:
    """Passages with ``<em>`` around matches and an ellipsis where text is left out; passages that touch are joined."""
    out, at = [], 0
    for s in found:
        if s["begin"] > at:
            out.append("…")
        at = s["begin"]
        for a, b in s["highlights"]:
            out += (escape(text[at:a]), "<em>", escape(text[a:b]), "</em>")
            at = b
        out.append(escape(text[at : s["end"]]))
        at = s["end"]
    if found and at < len(text):
        out.append("…")
    return "".join(out)


def may_match(text: Column, query: Query) -> Column:
    """False only for texts in which no positive leaf matches: a test in the JVM that spares Python the other texts.

    Only plain ASCII words are tested, as parts of the lower-cased text, and only in ASCII texts; whatever folding could
    change passes.
    """
    wanted = _needed(query)
    if wanted is None:
        return F.lit(True)
    low, hit = F.lower(text), text.rlike(r"[^\x00-\x7F]")
    for words in wanted:
        every = F.lit(True)
        for w in words:
            every = every & low.contains(w)
        hit = hit | every
    return F.coalesce(hit, F.lit(False))


def _needed(query: Query) -> list[list[str]] | None:
    """For each positive leaf on the text the words that a match needs; None if some leaf can't be told so."""
    if isinstance(query, (And, Or)):
        parts = [_needed(n) for n in query.nodes]
        return None if any(p is None for p in parts) else [w for p in parts for w in p]
    if isinstance(query, (Not, Regex)) or not hasattr(query, "field") or query.field.kind not in ("all", "text"):
        return []
    words = query_terms(query.text)
    if isinstance(query, Fuzzy) or not all(w.isascii() and w.isalnum() for w in words):
        return None
    return [words] if words else []


def highlight_documents(docs: DataFrame, query: Query) -> DataFrame:
    """(id, highlights) of documents with matches in their text; offsets in UTF-16 units."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [[{"begin": a, "end": b} for a, b in highlights(t or "", query)] for t in batch.text]
            yield pd.DataFrame({"id": batch.id, "highlights": spans})

    return docs.select("id", "text").filter(may_match(F.col("text"), query)).mapInPandas(run, "id long, highlights array<struct<begin:int,end:int>>").filter(F.size("highlights") > 0)


def snippet_documents(docs: DataFrame, query: Query) -> DataFrame:
    """(id, snippets, html); documents without matches are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, t in zip(batch.id, batch.text, strict=True):
                found = snippets(t or "", query)
                if found:
                    rows.append((i, [{"begin": s["begin"], "end": s["end"], "highlights": [{"begin": a, "end": b} for a, b in s["highlights"]]} for s in found], snippet_html(t, found)))
            yield pd.DataFrame(rows, columns=["id", "snippets", "html"])

    return docs.select("id", "text").filter(may_match(F.col("text"), query)).mapInPandas(run, "id long, snippets array<struct<begin:int,end:int,highlights:array<struct<begin:int,end:int>>>>, html string")


def highlight_json(text: str, query: Query) -> str:
    """``[[begin,end],...]`` in UTF-16 units."""
    return json.dumps([list(span) for span in highlights(text, query)], separators=(",", ":"))


def utf8_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans as spans of UTF-8 bytes."""
    return [(utf8_offset(text, a), utf8_offset(text, b)) for a, b in spans]
