"""Documents read over HTTP, by executors: an IRI to a task.

The server is asked for the formats that are known, best first, and the answer's format is what its media
type says, else the name in the IRI, else what the document starts with. An HTML page that names an
alternate of a known type in a Link header is read from there. Only http and https are opened.
"""

from __future__ import annotations

import json
import re
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import materialize
from ..terms import term_schema
from .readers import ALIASES, DOCUMENTS, EXTENSIONS, LINES, digest_of

SCHEMES = ("http://", "https://")
AGENT = "quadrille"
#: Media types that are asked for, with how much each is wanted.
ACCEPT = "text/turtle, application/trig, application/n-quads, application/n-triples;q=0.9, application/ld+json;q=0.9, application/rdf+xml;q=0.8, application/trix;q=0.7, text/n3;q=0.6, text/html;q=0.2, */*;q=0.1"
#: What a document may start with, after white space and comments, by format.
STARTS = [
    ("hext", r"\[\s*\"[^\n]*\]\s*(?:\n|$)"),
    ("jsonld", r"[\[{]"),
    ("trix", r"(?:<\?xml[^>]*\?>\s*)?(?:<!--.*?-->\s*)*<(?:\w+:)?TriX\b"),
    ("jsonld", r"<!doctype html|<html\b"),
    ("rdfxml", r"<\?xml\b|<!DOCTYPE\b|<(?:\w+:)?RDF\b|<!--"),
    ("patch", r"(?:TX|H|PA|A|D)[ \t]*(?:[<_.]|\w+ )"),
    ("nquads", r"(?:<[^<>\"{}|^`\\\s]*>|_:\S+)[ \t]+<[^<>\s]*>[ \t]+(?:<[^<>\s]*>|_:\S+|\"(?:[^\"\\\n]|\\.)*\"(?:@[\w-]+|\^\^<[^<>\s]*>)?)[ \t]*(?:(?:<[^<>\s]*>|_:\S+)[ \t]*)?\.[ \t]*(?:#[^\n]*)?(?:\n|$)"),
    ("trig", r"(?:(?:@prefix|@base|prefix|base)\b[^\n]*\n\s*)*(?:GRAPH\s*)?(?:<[^<>\s]*>|[\w.-]*:[\w.-]*)?\s*\{"),
]


def is_web(path) -> bool:
    return isinstance(path, str) and path.startswith(SCHEMES) or isinstance(path, (list, tuple)) and bool(path) and all(map(is_web, path))


def sniff(start: str, media: str = "", name: str = "") -> str:
    """The format of a document: by its media type, the extension of its name, or how it starts."""
    if media in ALIASES:
        return ALIASES[media]
    last = urllib.parse.urlsplit(name).path.rsplit("/", 1)[-1]
    if "." in last and (found := EXTENSIONS.get(last.rsplit(".", 1)[1].lower())):
        return found
    start = re.sub(r"\A(?:﻿|\s|#[^\n]*(?:\n|\Z))+", "", start)
    for form, pattern in STARTS:
        if re.match(pattern, start, re.IGNORECASE | re.DOTALL if pattern.startswith("(?:<") or pattern.startswith("<") else re.IGNORECASE):
            return form
    return "turtle"


def alternate(links: list[str], base: str) -> str | None:
    """The target of the first Link header with rel=alternate and the media type of a known format."""
    for link in links:
        for target, rest in re.findall(r"<([^>]*)>([^<]*)", link):
            given = {k.lower(): v for k, v in re.findall(r";\s*([\w*-]+)\s*=\s*\"?([^\";,]*)\"?", rest)}
            if "alternate" in given.get("rel", "").split() and given.get("type") in ALIASES:
                return urllib.parse.urljoin(base, target)
    return None


def fetch(iri: str, timeout: float = 60, accept: str = ACCEPT, follow: bool = True) -> tuple[str, str, bytes]:
    """(the IRI that answered, the media type, the content)."""
    if not iri.startswith(SCHEMES):
        raise ValueError(f"not an http IRI: {iri}")
    request = urllib.request.Request(urllib.parse.urldefrag(iri)[0], headers={"Accept": accept, "User-Agent": AGENT})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        media, links = answer.headers.get_content_type() if answer.headers.get("Content-Type") else "", answer.headers.get_all("Link") or []
        at = alternate(links, answer.url) if follow and media == "text/html" else None
        if at is None:
            return answer.url, media, answer.read()
    return fetch(at, timeout, accept, False)


def context_loader(timeout: float = 60):
    """Loads remote JSON-LD contexts, each once."""
    known: dict[str, object] = {}

    def load(iri: str):
        if iri not in known:
            known[iri] = json.loads(fetch(iri, timeout, "application/ld+json, application/json;q=0.9", False)[2])
        return known[iri]

    return load


class WebDocuments(DataSource):
    """(iri, form, content) of the documents at the IRIs of the option ``iris``, a JSON array."""

    @classmethod
    def name(cls) -> str:
        return "web_documents"

    def schema(self) -> str:
        return "iri string, form string, content string"

    def reader(self, schema) -> DataSourceReader:
        return WebReader(json.loads(self.options["iris"]), self.options.get("form"), float(self.options.get("timeout", 60)))


class WebReader(DataSourceReader):
    def __init__(self, iris: list[str], form: str | None, timeout: float):
        self.iris, self.form, self.timeout = iris, form, timeout

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(iri) for iri in self.iris]

    def read(self, partition):
        at, media, content = fetch(partition.value, self.timeout)
        text = content.decode("utf-8-sig")
        yield at, self.form or sniff(text[:4096], media, at), text


def read_web(spark: SparkSession, iris: str | list[str], form: str | None = None, base: str | None = None, strict: bool = True, timeout: float = 60, contexts: bool = True) -> DataFrame:
    """Quads (s, p, o, g) of documents on the web, whose formats may differ; blank nodes are kept apart by document.

    Each document is fetched once and kept in the shared checkpoint folder. ``contexts`` lets JSON-LD
    documents name contexts on the web.
    """
    iris = [iris] if isinstance(iris, str) else list(iris)
    spark.dataSource.register(WebDocuments)
    source = spark.read.format("web_documents").option("iris", json.dumps(iris)).option("timeout", str(timeout))
    form = ALIASES.get(form, form)
    docs = materialize((source.option("form", form) if form else source).load())

    def run(batches):
        import pandas as pd

        load = context_loader(timeout) if contexts else None
        for batch in batches:
            for iri, kind, text in zip(batch["iri"], batch["form"], batch["content"]):
                more = {"loader": load} if kind == "jsonld" else {}
                rows = list(DOCUMENTS[kind](text, base if base is not None else iri, f"f{digest_of(iri)}_", **more))
                yield pd.DataFrame([[None if t is None else t._asdict() for t in (*q, None)[:4]] for q in rows], columns=list("spog"))

    out = docs.where(F.col("form").isin(list(DOCUMENTS))).mapInPandas(run, term_schema(*"spog"))
    for kind, parse in LINES.items():
        lines = docs.where(F.col("form") == kind).select(F.explode(F.split("content", "\r\n|\r|\n")).alias("value"), F.col("iri").alias("file"))
        out = out.unionAll(parse(lines, F.col("file"), strict))
    return out.distinct()
