"""Training-data operators (scoring, filtering, deduplication, tokenisation).

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only when it can be imported.
"""
