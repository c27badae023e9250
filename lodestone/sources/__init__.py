"""Readers and the shared working folder."""

from lodestone.sources.scratch import materialize, scratch_path
from lodestone.sources.tables import table

__all__ = ["materialize", "scratch_path", "table"]
