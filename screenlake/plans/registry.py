"""All queries of the library and their SQL."""

from __future__ import annotations

from screenlake.plans import catalog, charts, documents, evaluation, overlays, packets, rationales, texts

QUERIES = catalog.QUERIES | charts.QUERIES | evaluation.QUERIES | texts.QUERIES | packets.QUERIES | overlays.QUERIES | rationales.QUERIES | documents.QUERIES
SQL = catalog.SQL | charts.SQL | evaluation.SQL | texts.SQL | packets.SQL | overlays.SQL | rationales.SQL | documents.SQL
FLAGSHIP = catalog.FLAGSHIP
