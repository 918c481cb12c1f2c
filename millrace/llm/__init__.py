"""Training-data operators: deduplication, scoring, tokenisation, decontamination.

Nothing outside this folder imports it; ``queries.py`` holds the registered queries.
"""
