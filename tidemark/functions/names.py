"""Names and ids of datasets, assets and drifts, as column expressions."""

from __future__ import annotations

import posixpath
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", "-"), F.lit("-"))


def dataset_name(urn: Column) -> Column:
    """The dotted name in a dataset urn; other texts are an error."""
    name = F.regexp_extract(urn, r"^urn:li:dataset:\(urn:li:dataPlatform:[^,]+,([^,]+),[^,)]+\)$", 1)
    return F.when(name != "", name).otherwise(F.raise_error(F.concat(F.lit("not a dataset urn: "), F.coalesce(urn, F.lit("null")))))


def asset_name(urn: Column) -> Column:
    """The last part of a dataset's name, or a job's name."""
    dataset = F.regexp_extract(urn, r"dataPlatform:[^,]+,(?:[^,]*\.)?([^,.]+),", 1)
    job = F.regexp_extract(urn, r",([^,()]+)\)$", 1)
    return F.when(dataset != "", dataset).when(job != "", job).otherwise(urn)


def drift_id(kind: Column, urn: Column, old: Column, new: Column) -> Column:
    subject = F.coalesce(old, new, F.lit("schema"))
    return F.concat_ws("-", F.lower(kind), slug(F.element_at(F.split(dataset_name(urn), r"\."), -1)), slug(subject))


def entity_url(base: str, urn: Column) -> Column:
    route = F.when(urn.startswith("urn:li:dataJob:"), "tasks").when(urn.startswith("urn:li:dataFlow:"), "pipelines").otherwise("dataset")
    return F.concat(F.lit(base.rstrip("/")), F.lit("/"), route, F.lit("/"), F.url_encode(urn))


def incident_id(drift: Column, urn: Column, column: Column) -> Column:
    """The same for the same facts, whenever it is computed."""
    return F.md5(F.to_json(F.struct(drift.alias("drift"), urn.alias("dataset"), column.alias("column"))))


def short_digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def safe_reference(reference: str) -> bool:
    """An http(s) address, or a relative path that stays inside its folder."""
    parts = urlsplit(reference)
    if parts.scheme:
        return parts.scheme in ("http", "https") and bool(parts.netloc)
    return bool(reference) and not reference.startswith(("/", "~", "\\")) and ".." not in reference.split("/") and posixpath.normpath(reference) == reference
