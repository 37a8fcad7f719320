"""Imports every query module of this folder, so that the registry is complete."""

from waymark.llm import q_pages, q_ranked, q_records, q_secrets, q_sequences, q_similar, q_text  # noqa: F401
from waymark.llm.registry import QUERIES, SQL  # noqa: F401
