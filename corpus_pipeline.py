"""From raw documents to packed training sequences: the stages and run() of the corpus subpackage."""

from vecspark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
