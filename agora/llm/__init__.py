"""Training-data operators: fingerprints, de-duplication, decontamination, PII, tokens, HTML.

Each ``opN``-style module holds one operator with its own interface; ``queries`` derives the
registered result tables from them.  Nothing else in the package imports this subpackage.
"""
