"""A corpus made ready for training: five stages, each over all that the one before it kept."""

from citegrid.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
