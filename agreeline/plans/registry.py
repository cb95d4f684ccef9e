"""All queries of the library, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from . import agreement, checks, frames, resampling, robustness

QUERIES = {**agreement.QUERIES, **robustness.QUERIES, **resampling.QUERIES, **checks.QUERIES, **frames.QUERIES}
ORACLES = {**agreement.ORACLES, **robustness.ORACLES, **resampling.ORACLES, **checks.ORACLES, **frames.ORACLES}
