"""Registered queries by family."""

import importlib

FAMILIES = ["text_queries", "timeline_queries", "interval_queries", "quality_queries", "overlay_queries", "ledger_queries", "web_queries", "pixel_queries", "memory_queries", "story_queries", "file_queries"]


def load() -> None:
    """Import every family, so that its queries are registered."""
    for name in FAMILIES:
        importlib.import_module(f"panelframe.plans.{name}")
