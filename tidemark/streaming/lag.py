"""How far a stream is behind its source, from the progress of its query."""

from __future__ import annotations

import json

from pyspark.sql.streaming import StreamingQuery


def positions(query: StreamingQuery) -> list[dict]:
    """Per source: the offset committed, the latest one known, and rows of the last batch."""
    progress = query.lastProgress
    if progress is None:
        return []
    progress = json.loads(progress.json) if hasattr(progress, "json") else progress
    return [{"source": s["description"], "committed": s["endOffset"], "latest": s.get("latestOffset"), "rows": s["numInputRows"]} for s in progress["sources"]]
