"""Imports every operator of the subpackage, so that its query registers; ``QUERIES`` and ``ORACLE`` by query name."""

from rimshot.llm import bpe, fingerprint, jaccard, lexical, licences, linededup, packing, pii, quality, secrets, spelling, toxicity, urls  # noqa: F401
from rimshot.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
