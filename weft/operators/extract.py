"""Tree-based extraction over pages: one parse for each page, many formats, in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

FORMATS = ("text", "formatted", "markdown", "main_text", "method", "confidence", "microdata", "rdfa", "json_ld", "schema", "clean", "fields", "structured")


def extract(pages: DataFrame, formats: tuple[str, ...] = ("markdown",), fields: dict[str, str] | None = None, schema: dict | None = None, hints: dict[str, str] | None = None, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id and a string column for each format (JSON where it is structured); errors keep their row.

    ``fields`` maps names to ``css`` or ``css@attribute``; ``schema`` and ``hints`` serve the format ``structured``.
    """
    unknown = [f for f in formats if f not in FORMATS]
    if unknown:
        raise ValueError(f"unknown formats: {unknown}")
    kind = pages.schema[page_id].dataType.simpleString()

    def one(source: str | None) -> dict[str, str | None]:
        from ..functions import dom

        root = dom.parse(source)
        node, method, confidence = dom.main_content(root)
        make = {
            "text": lambda: dom.block_text(root), "formatted": lambda: dom.formatted_text(root), "markdown": lambda: dom.markdown(node), "main_text": lambda: dom.block_text(node), "method": lambda: method, "confidence": lambda: str(confidence),
            "microdata": lambda: json.dumps(dom.microdata(root), ensure_ascii=False), "rdfa": lambda: json.dumps(dom.rdfa(root), ensure_ascii=False), "json_ld": lambda: json.dumps(dom.json_ld(root), ensure_ascii=False),
            "schema": lambda: json.dumps(dom.schema_items(root), ensure_ascii=False), "clean": lambda: dom.clean(root),
            "fields": lambda: json.dumps(dom.scrape(root, fields or {}), ensure_ascii=False), "structured": lambda: json.dumps(dom.structured(root, schema or {}, hints), ensure_ascii=False),
        }
        return {f: make[f]() for f in formats}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, errors = [], []
            for source in batch.column(1).to_pylist():
                try:
                    made.append(one(source))
                    errors.append(None)
                except Exception as e:  # a page that breaks the parser keeps its row
                    made.append({})
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m.get(f) for m in made], pa.string()) for f in formats), pa.array(errors, pa.string())], [page_id, *formats, "error"])

    return pages.select(page_id, html).mapInArrow(run, f"`{page_id}` {kind}, " + ", ".join(f"{f} string" for f in formats) + ", error string")
