"""Text cleaning, analysis into terms, the clustering lexer, and metadata values."""

from __future__ import annotations

import codecs
import json
import unicodedata

import pandas as pd
import regex
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: UTF-16 units of a document's text.
MOST_UNITS = 655_360
SIMPLE = r"[\p{L}\p{N}]+"
#: Words as in UAX #29: letters may be joined by an apostrophe, colon or dot between letters, digits by a dot or comma between digits.
WORD = r"[\p{L}\p{M}\p{N}_]+(?:(?:(?<=\p{L})['’.:](?=\p{L})|(?<=\p{N})[.,'](?=\p{N}))[\p{L}\p{M}\p{N}_]+)*"
_WORD = regex.compile(WORD)

STOP_LANGUAGES = {"da": "danish", "de": "german", "en": "english", "es": "spanish", "fi": "finnish", "fr": "french", "hu": "hungarian", "it": "italian", "nl": "dutch", "no": "norwegian", "pt": "portuguese", "ru": "russian", "sv": "swedish", "tr": "turkish"}


def textify(text: Column) -> Column:
    """Line ends become ``\\n``; other controls but tab become spaces; unassigned code points go."""
    lines = F.regexp_replace(text, "\r\n?|\x85", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", " "), r"\p{Cn}", "")


def textify_bytes(data: Column, charset: str) -> Column:
    """Decoded with replacement of what isn't valid, then cleaned.  UTF-8 and Latin 1 stay in the JVM; others are an Arrow UDF."""
    name = codecs.lookup(charset).name
    if name == "utf-8":
        return textify(F.make_valid_utf8(data.cast("string")))
    if name == "iso8859-1":
        return textify(F.decode(data, "ISO-8859-1"))

    def decoded(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else bytes(b).decode(charset, "replace"))

    return textify(F.pandas_udf(decoded, "string")(data))


def truncated(text: Column, units: int = MOST_UNITS) -> Column:
    """At most ``units`` UTF-16 units; a code point is never split.

    A code point beyond U+FFFF counts twice.  A text with any is cut where their number and its length reach the limit;
    since each cut leaves out code points only, a few rounds find the place: the number beyond U+FFFF in the first n.
    """
    beyond = lambda t: F.length(t) - F.length(F.regexp_replace(t, "[\\x{10000}-\\x{10FFFF}]", ""))
    short = F.substring(text, 1, units)

    def cut(t: Column) -> Column:
        # binary search for the greatest n with n + beyond(first n) <= units
        def step(acc: Column, _: Column) -> Column:
            middle = F.ceil((acc["low"] + acc["high"]) / 2).cast("int")
            fits = middle + beyond(F.left(t, middle)) <= units
            return F.struct(F.when(fits, middle).otherwise(acc["low"]).alias("low"), F.when(fits, acc["high"]).otherwise(F.greatest(middle - 1, acc["low"])).alias("high"))

        start = F.struct(F.lit(units // 2).alias("low"), F.length(t).alias("high"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(units.bit_length() + 1)), start, step, lambda acc: F.left(t, acc["low"]))

    return F.when(F.length(short) + beyond(short) <= units, short).otherwise(cut(short))


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits: the analyser that SQL can express too."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(SIMPLE), F.lit(0))


def words(text: Column) -> Column:
    """Word segments of the text, case kept, punctuation dropped (JVM side; no normalisation)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def fold(text: str) -> str:
    """NFKC with case folded, as search terms are compared."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def analyze(text: str) -> list[tuple[str, int, int]]:
    """(folded term, begin, end) of each word; offsets are code points of the text itself."""
    return [(fold(m.group()), m.start(), m.end()) for m in _WORD.finditer(text or "")]


def query_terms(text: str, analyzer: str = "unicode") -> list[str]:
    return [t for t, _, _ in analyze(text)] if analyzer == "unicode" else regex.findall(SIMPLE, (text or "").lower())


TOKEN = "array<struct<term:string,begin:int,end:int>>"
BLOCK = 64


def _token_rows(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"term": a, "begin": b, "end": c} for a, b, c in analyze(t or "")])


def unicode_tokens(text: Column) -> Column:
    return F.pandas_udf(_token_rows, TOKEN)(text)


def tokens(text: Column, analyzer: str) -> Column:
    """Array of term, begin, end.  "simple" stays in the JVM and takes offsets from the pieces between terms; "unicode" is an Arrow UDF."""
    if analyzer == "unicode":
        return unicode_tokens(text)
    text = F.coalesce(text, F.lit(""))
    pieces = F.split(text, SIMPLE, -1)
    found = F.regexp_extract_all(text, F.lit(SIMPLE), F.lit(0))
    # gathered in blocks, so that long texts aren't copied once a term
    start = F.struct(F.lit(0).alias("at"), F.array().cast(TOKEN).alias("block"), F.array().cast(f"array<{TOKEN}>").alias("full"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["word"])
        token = F.array(F.struct(F.lower(x["word"]).alias("term"), begin.alias("begin"), end.alias("end"))).cast(TOKEN)
        whole = F.size(acc["block"]) >= BLOCK
        block = F.when(whole, token).otherwise(F.concat(acc["block"], token))
        return F.struct(end.alias("at"), block.alias("block"), F.when(whole, F.concat(acc["full"], F.array(acc["block"]))).otherwise(acc["full"]).alias("full"))

    pairs = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda w, p: F.struct(w.alias("word"), F.length(p).alias("gap")))
    return F.aggregate(pairs, start, step, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["block"]))))


def utf16_offset(text: str, code_points: int) -> int:
    return len(text[:code_points].encode("utf-16-le", "surrogatepass")) // 2


def utf8_offset(text: str, code_points: int) -> int:
    return len(text[:code_points].encode("utf-8", "surrogatepass"))


def stop_words(language: str) -> list[str]:
    """Spark's public lists; a language without one has none."""
    name = STOP_LANGUAGES.get(language)
    return StopWordsRemover.loadDefaultStopWords(name) if name else []


def user_words(text: str) -> list[str]:
    """User-given words, split at white space and no-break spaces."""
    return [w for w in regex.split(r"[ \t\n\r ]+", text or "") if w]


LONGEST_TERM = 40
IMPORTANT = 5.0


def short_tokens(tokens: Column, most: int = LONGEST_TERM) -> Column:
    """Tokens of fewer than ``most`` characters: what the lexer is given for clustering."""
    return F.filter(tokens, lambda t: F.length(t) < most)


def weighted_terms(tokens: Column, stop: list[str], emphasis: dict[str, float]) -> Column:
    """The clustering lexer over an array of tokens: array of struct(term, weight).

    Tokens are cut to 40 characters.  One that an emphasis pattern finds keeps its case and multiplies the patterns'
    weights; another is lower-cased and dropped if it is shorter than 3, a stop word, or starts with a digit and is at
    least 40 % digits.
    """
    cut = F.transform(tokens, lambda t: F.substring(t, 1, LONGEST_TERM))

    def weighed(t: Column) -> Column:
        weight = F.lit(1.0)
        hit = F.lit(False)
        for pattern, w in emphasis.items():
            weight = weight * F.when(t.rlike(pattern), F.lit(float(w))).otherwise(F.lit(1.0))
            hit = hit | t.rlike(pattern)
        low = F.lower(t)
        digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
        plain = (F.length(low) >= 3) & ~(t.rlike("^[0-9]") & (digits * 10 >= F.length(t) * 4))
        plain = plain & ~low.isin(stop) if stop else plain
        return F.struct(F.when(hit, t).otherwise(low).alias("term"), weight.alias("weight"), (hit | plain).alias("keep"))

    kept = F.filter(F.transform(cut, weighed), lambda x: x["keep"])
    return F.transform(kept, lambda x: F.struct(x["term"].alias("term"), x["weight"].alias("weight")))


def metadata_value(metadata_json: Column, field: str) -> Column:
    """A field of a JSON object as text: a string as it is, other values as JSON, missing or null as empty."""
    path = "$['" + field.replace("'", "\\'") + "']"
    return F.coalesce(F.get_json_object(metadata_json, path), F.lit(""))


def clean_metadata(metadata_json: Column, fields: list[str]) -> Column:
    """The object with exactly the schema's fields, in order, all strings."""
    return F.to_json(F.struct(*[metadata_value(metadata_json, f).alias(f) for f in fields])) if fields else F.lit("{}")


def infer_fields(metadata_json: str) -> list[str]:
    value = json.loads(metadata_json or "{}")
    return list(value) if isinstance(value, dict) else []


DISPLAYS = ("TextInput", "Div", "Pre")


def parse_schema(text: str) -> list[dict]:
    """Fields of a metadata schema; raises ValueError unless its version is 1 and its types and displays are known."""
    value = json.loads(text)
    if not isinstance(value, dict) or value.get("version") != 1:
        raise ValueError("metadata schema: version must be 1")
    out = []
    for field in value.get("fields", []):
        field = {"name": field["name"], "type": field.get("type", "String"), "display": field.get("display", "TextInput")}
        if field["type"] != "String" or field["display"] not in DISPLAYS:
            raise ValueError(f"metadata schema: field {field['name']!r}")
        out.append(field)
    return out


def schema_of(fields: list[str]) -> str:
    """A metadata schema of text fields, as JSON: what an upload's metadata object gives a new set."""
    return json.dumps({"version": 1, "fields": [{"name": f, "type": "String"} for f in fields]})


def term_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, term) by the simple analyser."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(terms(F.col(text_col))).alias("pos", "term"))
