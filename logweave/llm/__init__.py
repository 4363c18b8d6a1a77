"""Operations of a training-data pipeline."""

from logweave.llm.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
