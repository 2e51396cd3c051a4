"""Operators of a training-data pipeline over the tables ``documents``, ``embeddings``, ``benchmark`` and ``labels``."""

from pyspark import cloudpickle

from crmkiln.llm import (
    arrays, decontaminate, language_id, ngram_join, quality_rules, repeats, substring_dedup,
    suffix_dedup, token_files, toxicity, whitening, word_cache,
)

# Executors need not have the package on their path: what tasks call travels with them.
for module in (arrays, decontaminate, language_id, ngram_join, quality_rules, repeats, substring_dedup,
               suffix_dedup, token_files, toxicity, whitening, word_cache):
    cloudpickle.register_pickle_by_value(module)
