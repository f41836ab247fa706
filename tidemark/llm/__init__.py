"""Training-data operators: deduplication, filtering, search, extraction, tokenising.

Each module holds one operator with a general DataFrame interface;
``queries`` derives the registered digest queries from them.
"""
