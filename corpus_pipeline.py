"""The corpus pipeline's stages, at the repository's top as its users call them; they are defined in cutframe.llm.pipeline."""

from cutframe.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
