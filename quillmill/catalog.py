"""All registered queries and their statements."""

from .plans import (  # noqa: F401  (each module registers its queries)
    conversation_queries,
    corpus_queries,
    evaluation_queries,
    run_queries,
    stream_queries,
    token_queries,
)
from .plans.evaluation_queries import unigram_bpb_by_lang as flagship  # noqa: F401
from .plans.registry import QUERIES, STATEMENTS  # noqa: F401
