"""Training-data operators: scoring, search, scans, de-duplication, token files, packing.

Nothing else in the library imports this subpackage. Queries and their SQL are in
``proofbox.llm.queries``; ``corpus_pipeline.py`` chains five of the operators.
"""
