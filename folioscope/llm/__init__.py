"""Training-data operators: quality, toxicity, tokens, search, secrets, near copies, mixing.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
``opN_`` queries, ``corpus_pipeline`` at the repository top chains five of them.
"""
