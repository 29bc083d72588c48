"""Selections: search, tags, nodes, objects, id lists, bit sets and view filters, combined, ordered and paged."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import plugins
from ..functions.ids import bits_to_numbers, ids_frame
from ..plans.ast import And, Everything, Not, Query, Regex, Warn, missing_fields
from ..plans.compile import MOST_EXPANSIONS, IndexSearch, regex_rules
from ..plans.parser import parse
from ..shared import BROADCAST_IDS, settled
from .sorting import canonical_order, field_order, page, positioned


@dataclass(frozen=True)
class SelectionRequest:
    document_set_id: int = 0
    q: str = ""
    document_ids: tuple[int, ...] = ()
    node_ids: tuple[int, ...] = ()
    store_object_ids: tuple[int, ...] = ()
    tag_ids: tuple[int, ...] = ()
    tagged: bool | None = None
    tag_operation: str = "any"
    bitset: str = ""
    view_filters: tuple[tuple[str, tuple[str, ...], str], ...] = ()
    sort_field: str = ""

    def key(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


@dataclass
class Selection:
    """rows(pos, id), frozen; warnings."""

    rows: DataFrame
    warnings: list[Warn] = field(default_factory=list)

    def count(self) -> int:
        if not hasattr(self, "_count"):
            self._count = self.rows.count()
        return self._count

    def page(self, offset: int = 0, limit: int = 100, reverse: bool = False, most: int = 1000) -> DataFrame:
        return page(self.rows, offset, limit, most, reverse, self.count() if reverse else None)


@dataclass
class Corpus:
    """The tables that selections read; those left out are taken as empty."""

    documents: DataFrame
    postings: DataFrame | None = None
    document_tag: DataFrame | None = None
    node_document: DataFrame | None = None
    document_store_object: DataFrame | None = None
    metadata_fields: tuple[str, ...] = ()
    analyzer: str = "unicode"
    dictionary: DataFrame | None = None
    most_expansions: int | None = MOST_EXPANSIONS

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession


def _few(spark: SparkSession, ids) -> DataFrame:
    frame = ids_frame(spark, list(ids))
    return F.broadcast(frame) if len(ids) <= BROADCAST_IDS else frame


def with_ids(docs: DataFrame, ids: tuple[int, ...]) -> DataFrame:
    return docs.join(_few(docs.sparkSession, ids), "id", "left_semi")


def linked(docs: DataFrame, bridge: DataFrame, column: str, values: tuple[int, ...], how: str = "left_semi") -> DataFrame:
    """Documents with (or, as an anti join, without) a bridge row whose ``column`` is among the values."""
    if not values:
        return docs.limit(0) if how == "left_semi" else docs
    rows = bridge.filter(F.col(column).isin(list(values))).select(F.col("document_id").alias("id")).distinct()
    return docs.join(rows, "id", how)


def with_tags(docs: DataFrame, document_tag: DataFrame, tag_ids: tuple[int, ...], tagged: bool | None, operation: str) -> DataFrame:
    """any: a tag of the list, or (un)tagged as asked; all: every tag of the list, and (un)tagged; none: no tag of the list, and the inverse of tagged."""
    if not tag_ids and tagged is None:
        return docs
    has = lambda i: F.max(F.when(F.col("tag_id") == i, 1).otherwise(0)) == 1
    hits = F.lit(False)
    every = F.lit(True)
    for i in dict.fromkeys(tag_ids):
        hits, every = hits | has(i), every & has(i)
    marks = document_tag.groupBy(F.col("document_id").alias("id")).agg(hits.alias("__any"), every.alias("__all"))
    marks = marks.select("id", "__any", "__all", F.lit(True).alias("__tagged"))
    joined = docs.join(marks, "id", "left")
    any_, all_, is_ = (F.coalesce(c, F.lit(False)) for c in ("__any", "__all", "__tagged"))
    if not tag_ids:
        keep = is_ == (tagged if operation != "none" else not tagged)
    elif operation == "all":
        keep = all_ if tagged is None else all_ & (is_ == tagged)
    elif operation == "none":
        keep = ~any_ if tagged is None else ~any_ & (is_ == (not tagged))
    else:
        keep = any_ if tagged is None else any_ | (is_ == tagged)
    return joined.filter(keep).drop("__any", "__all", "__tagged")


def in_bitset(docs: DataFrame, document_set_id: int, encoded: str) -> DataFrame:
    """Documents whose number in the set is a set bit; text that isn't base 64 filters nothing."""
    numbers = bits_to_numbers(encoded)
    return docs if numbers is None else with_ids(docs, tuple((document_set_id << 32) | n for n in numbers))


def search_ids(corpus: Corpus, query: Query, warnings: list[Warn]) -> DataFrame:
    search = IndexSearch(corpus.postings, corpus.documents.select("id"), corpus.analyzer, corpus.most_expansions, corpus.dictionary)
    found = search.search(query)
    warnings += search.warnings
    return found


def _only_regexes(query: Query) -> bool:
    nodes = query.nodes if isinstance(query, And) else [query]
    return all(isinstance(n, (Everything, Regex)) or (isinstance(n, Not) and isinstance(n.node, Regex)) for n in nodes)


def filtered(corpus: Corpus, request: SelectionRequest, warnings: list[Warn]) -> DataFrame:
    """The documents of a request, unordered: index-like filters first, regular expressions on what is left."""
    docs = corpus.documents
    query = parse(request.q)
    warnings += missing_fields(query, list(corpus.metadata_fields))
    if request.document_ids:
        docs = with_ids(docs, request.document_ids)
    if request.bitset:
        docs = in_bitset(docs, request.document_set_id, request.bitset)
    if request.node_ids:
        docs = linked(docs, corpus.node_document, "node_id", request.node_ids)
    if request.store_object_ids:
        docs = linked(docs, corpus.document_store_object, "store_object_id", request.store_object_ids)
    docs = with_tags(docs, corpus.document_tag, request.tag_ids, request.tagged, request.tag_operation) if request.tag_ids or request.tagged is not None else docs
    for name, ids, operation in request.view_filters:
        try:  # the ids are made here, so that a plug-in which fails while it runs filters nothing, too
            docs = docs.join(settled(plugins.FILTERS[name](corpus.spark, list(ids), operation).select("id"), "view-filter"), "id", "left_semi")
        except Exception as e:  # noqa: BLE001  whatever the plug-in raises
            warnings.append(Warn("ViewFilterError", name, f"{type(e).__name__}: {e}"))
    if not _only_regexes(query):
        docs = docs.join(search_ids(corpus, query, warnings), "id", "left_semi")
    rules, more = regex_rules(query)
    warnings += more
    for rule in rules:
        docs = docs.filter(rule.column(docs))
    return docs


def select(corpus: Corpus, request: SelectionRequest, regex_limit: int | None = None) -> Selection:
    """Ordered, frozen ids of a request.  Raises QuerySyntaxError.

    ``regex_limit``: test regular expressions on so many first candidates only and drop the rest, with a warning; by
    default all candidates are tested.
    """
    warnings: list[Warn] = []
    order = canonical_order()
    if request.sort_field:
        if request.sort_field in corpus.metadata_fields:
            order = field_order(F.col("metadata_json"), request.sort_field)
        else:
            warnings.append(Warn("MissingField", request.sort_field, ", ".join(corpus.metadata_fields)))
    rules, _ = regex_rules(parse(request.q))
    if rules and regex_limit is not None:
        query = parse(request.q)
        rest = [n for n in (query.nodes if isinstance(query, And) else [query]) if not _only_regexes(n)]
        plain = Corpus(**corpus.__dict__)
        docs = _filter_tree(plain, request, And(tuple(rest)) if rest else Everything(), warnings)
        first = settled(docs.orderBy(*order).limit(regex_limit + 1), "regex-candidates")
        if first.count() > regex_limit:
            warnings.append(Warn("RegexLimited", request.q, str(regex_limit)))
        docs = first.orderBy(*order).limit(regex_limit)
        for rule in rules:
            docs = docs.filter(rule.column(docs))
    else:
        docs = filtered(corpus, request, warnings)
    return Selection(positioned(docs.select(*_order_columns(docs)), order).select("pos", "id"), warnings)


def _filter_tree(corpus: Corpus, request: SelectionRequest, query: Query, warnings: list[Warn]) -> DataFrame:
    without = SelectionRequest(**(asdict(request) | {"q": "", "view_filters": request.view_filters}))
    docs = filtered(corpus, without, warnings)
    return docs if isinstance(query, Everything) else docs.join(search_ids(corpus, query, warnings), "id", "left_semi")


class SelectionCache:
    """Selections by request, for ``ttl`` seconds; ``refresh`` makes anew.  A selection's rows are a written table."""

    def __init__(self, ttl: float = 3600.0, now=time.monotonic):
        self.ttl, self.now, self.held = ttl, now, {}

    def find_or_create(self, corpus: Corpus, request: SelectionRequest, refresh: bool = False) -> Selection:
        key, now = request.key(), self.now()
        for old in [k for k, (t, _) in self.held.items() if now - t > self.ttl]:
            del self.held[old]
        if refresh or key not in self.held:
            selection = select(corpus, request)
            selection.rows = settled(selection.rows, "selection")
            self.held[key] = (now, selection)
        return self.held[key][1]

    def find(self, key: str) -> Selection | None:
        """A selection by the key of its request, while it is held."""
        made, selection = self.held.get(key, (None, None))
        return selection if made is not None and self.now() - made <= self.ttl else None


class SortCache:
    """Positions of a document set's documents by (set, field), each sorted once; ``changed`` drops a set's when its documents change."""

    def __init__(self):
        self.held: dict[tuple[int, str], DataFrame] = {}

    def positions(self, corpus: Corpus, document_set_id: int, field_name: str = "") -> DataFrame:
        """(id, pos) of all documents of the set, in the field's order or, without one, the canonical order."""
        key = (document_set_id, field_name)
        if key not in self.held:
            docs = corpus.documents.filter(F.col("document_set_id") == document_set_id)
            order = field_order(F.col("metadata_json"), field_name) if field_name else canonical_order()
            self.held[key] = settled(positioned(docs.select(*_order_columns(docs)), order).select("id", "pos"), "positions")
        return self.held[key]

    def changed(self, document_set_id: int, field_name: str | None = None) -> None:
        """Forget a set's positions: by one field, or, as titles and the set of documents count in every order, all."""
        for key in [k for k in self.held if k[0] == document_set_id and field_name in (None, k[1])]:
            del self.held[key]

    def ordered(self, corpus: Corpus, document_set_id: int, found: DataFrame, field_name: str = "") -> DataFrame:
        """(pos, id) of some documents of the set: places in the whole set's order are closed up, by a sort of numbers only."""
        whole = self.positions(corpus, document_set_id, field_name)
        return positioned(whole.join(found.select("id"), "id", "left_semi").withColumnRenamed("pos", "__at"), [F.col("__at")]).select("pos", "id")


def _order_columns(docs: DataFrame) -> list[str]:
    return [c for c in ("id", "title", "supplied_id", "page_number", "metadata_json") if c in docs.columns]


API_FIELDS = ("id", "documentSetId", "isFromOcr", "metadata", "pageNumber", "suppliedId", "text", "title", "tokens", "url")
DEFAULT_FIELDS = ("id", "pageNumber", "suppliedId", "title", "url")


def documents_for_clustering(documents: DataFrame, document_tag: DataFrame | None = None, tag_id: int | None = None) -> DataFrame:
    """A set's documents, or only those with one tag, in canonical order."""
    if tag_id is not None:
        documents = linked(documents, document_tag, "tag_id", (tag_id,))
    return documents.orderBy(*canonical_order())


def parse_fields(text: str) -> tuple[str, ...]:
    """Known names of a comma list, id always among them; the default ones if none is known."""
    asked = [x for x in (text or "").split(",") if x in API_FIELDS]
    return tuple(dict.fromkeys(["id", *asked])) if asked else DEFAULT_FIELDS


def projected(docs: DataFrame, fields: tuple[str, ...], tokens: Column | None = None) -> DataFrame:
    """API columns of documents; columns that aren't asked for are never read."""
    source = {"documentSetId": "document_set_id", "isFromOcr": "is_from_ocr", "metadata": "metadata_json", "pageNumber": "page_number", "suppliedId": "supplied_id"}
    return docs.select(*[(tokens if f == "tokens" and tokens is not None else F.col(source.get(f, f))).alias(f) for f in fields])


def view_url(docs: DataFrame) -> Column:
    """none and a file: /documents/{id}.pdf; local://x: /localfiles/x; else the URL."""
    url = F.col("url")
    from_file = F.concat(F.lit("/documents/"), F.col("id").cast("string"), F.lit(".pdf"))
    return F.when(url.isNull() & F.col("file2_id").isNotNull(), from_file).when(url.startswith("local://"), F.concat(F.lit("/localfiles/"), F.substring(url, 9, 1 << 30))).otherwise(url)
