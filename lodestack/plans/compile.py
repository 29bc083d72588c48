"""From query trees to plans: over the postings table, or straight over documents.

Over postings every leaf becomes a filter on (field, term) that prunes the sorted table, one aggregation by document at
most, and boolean nodes become semi, anti and distinct-union joins of id tables.  Over documents a query becomes one
boolean column: no shuffle at all, the cheaper way for a set without an index.  Both give the same documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold, metadata_value, query_terms
from .ast import And, Everything, Field, Fuzzy, Leaf, Not, Or, Prefix, Proximity, Query, Regex, Warn

MOST_EXPANSIONS = 1000
MOST_FUZZ = 2
#: Terms written into a filter.
MOST_LISTED = 1000


@dataclass
class IndexSearch:
    """Searches of one document set.  postings: its index, None if there is none; ids: all its document ids.

    dictionary: the index's (field, term), in which fuzzy terms and prefixes are looked up; without one, the postings are.
    ``most_expansions``: terms that the last word of a phrase prefix may stand for, with a warning beyond; None for any number.
    """

    postings: DataFrame | None
    ids: DataFrame
    analyzer: str = "unicode"
    most_expansions: int | None = MOST_EXPANSIONS
    dictionary: DataFrame | None = None
    warnings: list[Warn] = field(default_factory=list)

    def search(self, query: Query) -> DataFrame:
        """Ids of the matching documents, each once.  Warnings are added to ``self.warnings``."""
        if self.postings is None:
            self.warnings.append(Warn("IndexDoesNotExist"))
            return self.ids.select("id").limit(0)
        return self._ids(query)

    def _ids(self, query: Query) -> DataFrame:
        if isinstance(query, (Everything, Regex)) or (isinstance(query, Not) and isinstance(query.node, Regex)):
            return self.ids.select("id")
        if isinstance(query, And):
            out = self._ids(query.nodes[0]) if not isinstance(query.nodes[0], Not) else self.ids.select("id")
            for node in query.nodes if isinstance(query.nodes[0], Not) else query.nodes[1:]:
                negated = isinstance(node, Not) and not isinstance(node.node, Regex)
                out = out.join(self._ids(node.node if negated else node), "id", "left_anti" if negated else "left_semi")
            return out
        if isinstance(query, Or):
            out = self._ids(query.nodes[0])
            for node in query.nodes[1:]:
                out = out.union(self._ids(node))
            return out.distinct()
        if isinstance(query, Not):
            return self.ids.select("id").join(self._ids(query.node), "id", "left_anti")
        return self._leaf(query)

    def _rows(self, f: Field) -> DataFrame:
        return self.postings.filter(F.col("field").isin(self._names(f)))

    def _names(self, f: Field) -> list[str]:
        return {"all": ["title", "text"], "metadata": [f"meta:{f.name}"]}.get(f.kind, [f.kind])

    def _terms(self, f: Field) -> DataFrame:
        """Terms of a field, each once."""
        source = self.postings if self.dictionary is None else self.dictionary
        return source.filter(F.col("field").isin(self._names(f))).select("term").distinct()

    def _leaf(self, leaf: Leaf) -> DataFrame:
        rows, nothing = self._rows(leaf.field), self.ids.select("id").limit(0)
        if isinstance(leaf, Fuzzy):
            test = self._fuzzy(leaf)
            if self.dictionary is None:
                return rows.filter(test).select("id").distinct()
            near = self._terms(leaf.field).filter(test)
            found = [r.term for r in near.limit(MOST_LISTED + 1).collect()]
            few = len(found) <= MOST_LISTED  # a list prunes the sorted postings; a longer one is joined
            return (rows.filter(F.col("term").isin(found)) if few else rows.join(near, "term", "left_semi")).select("id").distinct()
        terms = query_terms(leaf.text, self.analyzer)
        if not terms:
            return nothing
        if isinstance(leaf, Prefix):
            last = terms[-1]
            if len(terms) == 1:
                return rows.filter(F.col("term").startswith(last)).select("id").distinct()
            if self.most_expansions is None:
                return self._phrase_prefix(rows, terms[:-1], last)
            found = [r.term for r in self._terms(leaf.field).filter(F.col("term").startswith(last)).orderBy("term").limit(self.most_expansions + 1).collect()]
            if len(found) > self.most_expansions:
                self.warnings.append(Warn("TooManyExpansions", leaf.text, str(self.most_expansions)))
            found = found[: self.most_expansions]
            return self._placed(rows, [[t] for t in terms[:-1]] + [found], 0) if found else nothing
        if isinstance(leaf, Proximity):
            return self._placed(rows, [[t] for t in terms], leaf.slop)
        return self._placed(rows, [[t] for t in terms], 0)

    def _placed(self, rows: DataFrame, terms: list[list[str]], slop: int) -> DataFrame:
        """Documents in which the terms stand one after another, or with ``slop`` within that many moves."""
        wanted = sorted({t for group in terms for t in group})
        rows = rows.filter(F.col("term").isin(wanted))
        if len(terms) == 1:
            return rows.select("id").distinct()
        per = rows.groupBy("id", "field").agg(*[F.sort_array(F.collect_set(F.when(F.col("term").isin(group), F.col("pos")))).alias(f"p{i}") for i, group in enumerate(terms)])
        places = [F.col(f"p{i}") for i in range(len(terms))]
        return per.filter(placed(places, slop)).select("id").distinct()

    def _phrase_prefix(self, rows: DataFrame, first: list[str], prefix: str) -> DataFrame:
        """Documents with the first words and, right behind them, any word that begins with the prefix."""
        tests = [F.col("term") == t for t in first] + [F.col("term").startswith(prefix)]
        hit = F.lit(False)
        for t in tests:
            hit = hit | t
        per = rows.filter(hit).groupBy("id", "field").agg(*[F.sort_array(F.collect_set(F.when(t, F.col("pos")))).alias(f"p{i}") for i, t in enumerate(tests)])
        return per.filter(placed([F.col(f"p{i}") for i in range(len(tests))], 0)).select("id").distinct()

    def _fuzzy(self, leaf: Fuzzy) -> Column:
        most = MOST_FUZZ if leaf.distance is None else leaf.distance
        if most > MOST_FUZZ:
            self.warnings.append(Warn("TooMuchFuzz", leaf.text, str(MOST_FUZZ)))
            most = MOST_FUZZ
        return near_term(F.col("term"), fold(leaf.text), most)


def placed(places: list[Column], slop: int) -> Column:
    """Whether some place of each term makes the phrase: with slop 0 consecutive, else max - min of (place - index) <= slop, no place used twice."""
    if slop == 0:
        return F.exists(places[0], lambda p: _all([F.array_contains(x, p + i) for i, x in enumerate(places) if i]))

    def some(i: int, low: Column | None, high: Column | None, used: list[Column]) -> Column:
        if i == len(places):
            return F.lit(True)

        def here(p: Column) -> Column:
            at = p - i
            new_low, new_high = (at, at) if low is None else (F.least(low, at), F.greatest(high, at))
            fits = (new_high - new_low <= slop) & _all([p != u for u in used])
            return fits & some(i + 1, new_low, new_high, [*used, p])

        return F.exists(places[i], here)

    return some(0, None, None, [])


def _all(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def near_term(term: Column, wanted: str, most: int) -> Column:
    """Edit distance with transpositions of at most ``most`` (0, 1 or 2): plain distance, or one neighbour swap and the rest."""
    if most <= 0:
        return term == wanted
    swapped = {wanted[:i] + wanted[i + 1] + wanted[i] + wanted[i + 2 :] for i in range(len(wanted) - 1)} - {wanted}
    near = F.levenshtein(term, F.lit(wanted)) <= most
    for w in sorted(swapped):
        near = near | (F.levenshtein(term, F.lit(w)) <= most - 1)
    if most > 1:
        twice = {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in swapped for i in range(len(w) - 1)} - swapped - {wanted}
        near = near | term.isin(sorted(twice)) if twice else near
    return F.length(term).between(len(wanted) - most, len(wanted) + most) & near


def scan_column(query: Query, arrays: dict[str, Column], warnings: list[Warn] | None = None) -> Column:
    """A query as a boolean column over arrays of simple terms by field name (title, text, notes, meta:<name>)."""
    warnings = [] if warnings is None else warnings
    if isinstance(query, (Everything, Regex)):
        return F.lit(True)
    if isinstance(query, And):
        return _all([scan_column(n, arrays, warnings) for n in query.nodes])
    if isinstance(query, Or):
        out = F.lit(False)
        for n in query.nodes:
            out = out | scan_column(n, arrays, warnings)
        return out
    if isinstance(query, Not):
        return F.lit(True) if isinstance(query.node, Regex) else ~scan_column(query.node, arrays, warnings)
    names = {"all": ["title", "text"], "metadata": [f"meta:{query.field.name}"]}.get(query.field.kind, [query.field.kind])
    out = F.lit(False)
    for name in names:
        if name in arrays:
            out = out | _scan_leaf(query, arrays[name], warnings)
    return out


def _scan_leaf(leaf: Leaf, terms: Column, warnings: list[Warn]) -> Column:
    if isinstance(leaf, Fuzzy):
        most = MOST_FUZZ if leaf.distance is None else leaf.distance
        if most > MOST_FUZZ:
            warnings.append(Warn("TooMuchFuzz", leaf.text, str(MOST_FUZZ)))
        return F.exists(terms, lambda t: near_term(t, fold(leaf.text), min(most, MOST_FUZZ)))
    wanted = query_terms(leaf.text, "simple")
    if not wanted:
        return F.lit(False)
    open_end = isinstance(leaf, Prefix)
    if len(wanted) == 1:
        return F.exists(terms, lambda t: t.startswith(wanted[0])) if open_end else F.array_contains(terms, wanted[0])
    places = [_places(terms, w, open_end and i == len(wanted) - 1) for i, w in enumerate(wanted)]
    return placed(places, leaf.slop if isinstance(leaf, Proximity) else 0)


def _places(terms: Column, wanted: str, open_end: bool) -> Column:
    hit = (lambda t: t.startswith(wanted)) if open_end else (lambda t: t == wanted)
    return F.array_compact(F.transform(terms, lambda t, i: F.when(hit(t), i)))


@dataclass(frozen=True)
class RegexRule:
    field: Field
    pattern: str
    negated: bool = False

    def column(self, docs: DataFrame) -> Column:
        """Whether a document passes.  Patterns are Java regular expressions, found anywhere in the field."""
        find = lambda c: F.coalesce(c.rlike(self.pattern), F.lit(False))
        kind = self.field.kind
        if kind == "all":
            hit = find(F.col("title")) | find(F.col("text"))
        elif kind == "metadata":
            hit = find(metadata_value(F.col("metadata_json"), self.field.name))
        elif kind == "notes":
            hit = F.coalesce(F.exists("pdf_notes", lambda n: n["text"].rlike(self.pattern)), F.lit(False)) if "pdf_notes" in docs.columns else F.lit(False)
        else:
            hit = find(F.col(kind))
        return ~hit if self.negated else hit


def pattern_error(pattern: str) -> str | None:
    """What Java, which runs the patterns, finds wrong with one; None for a good one.  Without a session Python's rules stand in."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        else:
            re.compile(pattern)
    except (IllegalArgumentException, re.error) as e:
        return str(e).partition("\n")[0]
    return None


def regex_rules(query: Query) -> tuple[list[RegexRule], list[Warn]]:
    """Regexes that stand alone or in the top-level AND, maybe negated, are rules; deeper ones are ignored with a warning."""
    rules, warnings = [], []
    for node in query.nodes if isinstance(query, And) else [query]:
        bare = node.node if isinstance(node, Not) else node
        if isinstance(bare, Regex):
            if wrong := pattern_error(bare.text):
                warnings.append(Warn("RegexSyntaxError", bare.text, wrong))
            else:
                rules.append(RegexRule(bare.field, bare.text, isinstance(node, Not)))
        else:
            warnings += [Warn("NestedRegexIgnored", x.text) for x in _regexes(bare)]
    return rules, warnings


def _regexes(query: Query) -> list[Regex]:
    if isinstance(query, Regex):
        return [query]
    if isinstance(query, Not):
        return _regexes(query.node)
    if isinstance(query, (And, Or)):
        return [x for n in query.nodes for x in _regexes(n)]
    return []
