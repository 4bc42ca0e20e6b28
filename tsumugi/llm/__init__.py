"""Training-data operators: filtering, deduplication, tokenisation, archives and scoring.

Nothing outside this package imports it.  Each operator module holds a general
interface; ``queries`` derives the registered ``opN_*`` queries from them.
"""
