"""All queries of the subpackage; importing a module registers its queries."""

from terrapulse.llm import chat, imatch, knn, leaks, main_text, merkle, packing, secrets, simhash, substrings, token_counts, toxicity, whitening  # noqa: F401
from terrapulse.llm.common import ORACLE, QUERIES  # noqa: F401
