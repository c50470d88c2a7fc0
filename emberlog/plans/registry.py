"""All registered queries with their SQL twins."""

from __future__ import annotations

from emberlog.plans import code_catalog, events_catalog, facets_catalog, lines_catalog, stream_catalog

CATALOGS = [events_catalog, facets_catalog, lines_catalog, code_catalog, stream_catalog]


def entries() -> dict:
    out = {}
    for catalog in CATALOGS:
        out.update(catalog.ENTRIES)
    return out
