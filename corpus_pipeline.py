"""From a documents table to token ids: the stages, their run over all documents and their SQL, from ``subtide.llm.pipeline``."""

from subtide.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
