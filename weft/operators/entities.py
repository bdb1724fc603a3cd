"""Entities of whole texts, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("people", "places", "organizations", "dates", "money", "other")


def with_entities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, an array for each kind of entity, total, unique and density of every text; a null text has none."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..functions import entities

        for batch in batches:
            found = [entities.extract(t) for t in batch.column(1).to_pylist()]
            lists = [pa.array([f[k] for f in found], pa.list_(pa.string())) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, *(pa.array([f[k] for f in found], pa.int64()) for k in ("total", "unique")), pa.array([f["density"] for f in found], pa.float64())], [doc_id, *KINDS, "total", "unique", "density"])

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, " + ", ".join(f"{k} array<string>" for k in KINDS) + ", total long, unique long, density double")


def entity_counts(found: DataFrame) -> DataFrame:
    """kind, entity (in small letters), n (documents): how many documents name each entity."""
    def of(kind: str) -> Column:
        return F.transform(kind, lambda e: F.struct(F.lit(kind).alias("kind"), e.alias("entity")))

    none = F.array().cast("array<struct<kind: string, entity: string>>")
    rows = found.select(F.explode(F.concat(*(F.coalesce(of(k), none) for k in KINDS))).alias("e"))
    return rows.groupBy(F.col("e.kind").alias("kind"), F.lower("e.entity").alias("entity")).agg(F.count("*").alias("n"))
