from __future__ import annotations


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}
