"""Estimates documents (XML) and fetched result pages (HTML)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTRIBUTE, TEXT = "_", "_VALUE"


def _content(value: Column, kind: T.DataType) -> Column:
    """Element content: text, a list for one repeated child, else a map of children."""
    if not isinstance(kind, T.StructType):
        return value
    children = [f for f in kind.fields if not f.name.startswith(ATTRIBUTE)]
    if not children:
        return value[TEXT]
    if len(children) == 1 and isinstance(children[0].dataType, T.ArrayType):
        child = children[0]
        return F.transform(value[child.name], lambda one: F.struct(*_entries(one, child.dataType.elementType, child.name)))
    return F.struct(*[entry for f in children for entry in _entries(value[f.name], f.dataType, f.name)])


def _entries(value: Column, kind: T.DataType, tag: str) -> list[Column]:
    """An element under its tag, its attributes under ``<tag>Attrs``."""
    if isinstance(kind, T.ArrayType):
        listed = F.transform(value, lambda one: F.struct(*_entries(one, kind.elementType, tag)))
        return [listed.alias(tag)]
    found = [_content(value, kind).alias(tag)]
    if isinstance(kind, T.StructType):
        names = [f.name for f in kind.fields if f.name.startswith(ATTRIBUTE) and f.name != TEXT]
        if names:
            attrs = F.struct(*[value[name].alias(name[len(ATTRIBUTE) :]) for name in names])
            found.append(attrs.alias(f"{tag}Attrs"))
    return found


def xml_to_map(xml: Column, schema: str | T.StructType, tag: str) -> Column:
    """XML text to nested maps and lists under the root tag."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    parsed = F.from_xml(xml, kind.simpleString(), {"attributePrefix": ATTRIBUTE, "valueTag": TEXT})
    return F.struct(*_entries(parsed, kind, tag))


def read_estimates(documents: DataFrame, schema: str | T.StructType, tag: str, now: Column) -> DataFrame:
    """Document XML per ticker (``ticker``, ``xml``) to JSON, stamped with the load time."""
    estimates = F.when(F.length("xml") > 0, F.to_json(xml_to_map(F.col("xml"), schema, tag)))
    return documents.select("ticker", now.alias("date"), estimates.alias("estimates"))


def page_text(html: Column, container: str) -> Column:
    """Text of the container element without its tags."""
    inner = F.regexp_extract(html, container, 1)
    return F.trim(F.regexp_replace(F.regexp_replace(inner, "<[^>]*>", " "), r"\s+", " "))


# The container of the result table in a screener page.
RESULTS = r'(?s)<div[^>]*id="screener-content"[^>]*>(.*?)</div>'


def tickers_from_pages(pages: DataFrame, container: str = RESULTS) -> DataFrame:
    """One row per blank-separated token of the result text."""
    tokens = F.explode(F.split(page_text(F.col("html"), container), " "))
    return pages.select(*[name for name in pages.columns if name != "html"], tokens.alias("ticker")).where(F.col("ticker") != "")
