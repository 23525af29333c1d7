"""The package's queries, by importing the modules that register them."""

from . import (bpe, classifier, decontaminate, exact_topk, filter_audit, language, licenses, quality_rules, repeats, sharding,   # noqa: F401
               simhash, token_alignment, token_counts)
from .registry import ORACLES, QUERIES         # noqa: F401
