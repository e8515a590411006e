"""The corpus pipeline of the training-data operators; quarry/llm/pipeline.py holds it."""

from __future__ import annotations

from quarry.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
