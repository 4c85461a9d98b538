"""Passages that sources say with a few words changed."""

from __future__ import annotations

from factloom.operators import anchors as A
from factloom.queries.base import query


def spans(t):
    return A.approximate_spans(t("benchmark"), t("documents"), "item_id", "doc_id", "text")


@query()
def x17_approximate_anchors(t):
    """X-17: the best span of every document that keeps at least 58 per cent of a passage's words."""
    return spans(t)


@query()
def x26_anchor_status(t):
    """X-26: passages that documents support word by word, nearly, or not."""
    return A.anchor_status(t("benchmark"), spans(t), "item_id", "doc_id", "text")
