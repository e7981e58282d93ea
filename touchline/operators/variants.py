"""Raw event documents as VARIANT: parsed once, read by path without a schema, with every key kept.

A feed's events carry properties that differ by provider and season. As VARIANT a document is one binary value with its own
keys: what the operators know is taken out by path and type, what they do not know stays in the column and can be listed or asked
for later, and no schema is inferred from, or forced on, the rest. All functions are built in and run in the JVM.

Malformed text gives a null document, which rejected() returns with its text; a path that is not there, or does not fit its type, is
null. Keys are case-sensitive. A document that is no object has no events and no other keys. Repeated rows stay. A long document is
one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EVENTS = "array<struct<event_name:string,property:map<string,string>>>"


def parsed(rows: DataFrame, text: str, out: str = "document") -> DataFrame:
    return rows.withColumn(out, F.try_parse_json(F.col(text)))


def rejected(rows: DataFrame, text: str, document: str = "document") -> DataFrame:
    """The rows whose text is no JSON."""
    return rows.where(F.col(document).isNull() & F.col(text).isNotNull())


def at(document: str | Column, path: str, kind: str) -> Column:
    """The value at a path such as $.a.b[0], or null."""
    return F.try_variant_get(F.col(document) if isinstance(document, str) else document, path, kind)


def events_of(document: str, path: str = "$.events") -> Column:
    """The nested events, ready for events.renamed and events.simplified; property values of any kind become text."""
    return F.coalesce(at(document, path, EVENTS), F.array().cast(EVENTS))


def keys_of(rows: DataFrame, document: str = "document") -> DataFrame:
    """rows with key and value (VARIANT) of every member of the document, a row each."""
    rows.createOrReplaceTempView("_touchline_documents")
    return rows.sparkSession.sql(f"SELECT d.*, e.key, e.value FROM _touchline_documents d, LATERAL variant_explode(d.`{document}`) e")


def unknown_keys(rows: DataFrame, known: list[str], keys: list[str], document: str = "document") -> DataFrame:
    """keys, key, value as JSON text of the members that the operators do not know."""
    found = keys_of(rows, document).where(~F.col("key").isin(*known))
    return found.select(*keys, "key", F.to_json("value").alias("value"))


def schema_of(rows: DataFrame, document: str = "document") -> str:
    """The merged schema of all documents, as one DDL text: an aggregate, nothing is collected but the text."""
    return rows.agg(F.schema_of_variant_agg(document)).first()[0]
