"""Registered queries: every operator on the driver tables, with the SQL it is checked against."""

from __future__ import annotations

from tunefathom.queries.registry import QUERIES, Query  # noqa: F401


def load() -> dict[str, Query]:
    """All registered queries by name."""
    from tunefathom.queries import (  # noqa: F401
        aggregates, catalogue, features, filters, matching, playlists, rollups, series, sources, streams, texts,
    )
    return QUERIES
