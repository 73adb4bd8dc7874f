"""Logging for entry points; library modules only take loggers."""

from __future__ import annotations

import logging

from docloom.config import Settings


def setup(settings: Settings) -> None:
    logging.basicConfig(level=getattr(logging, settings.log_level.upper(), logging.INFO), format="%(asctime)s %(name)s %(levelname)s %(message)s", force=True)
    if settings.debug:
        logging.getLogger("docloom").warning("debug is on: logs hold contents of documents")


def preview(value: object, limit: int = 2000) -> str:
    """A value for the log, its length noted where it is cut."""
    text = str(value)
    return text if len(text) <= limit else f"{text[:limit]}… [truncated {len(text) - limit} of {len(text)} chars]"
