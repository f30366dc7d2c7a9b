"""Training-data operators: deduplication, tokenisation, quality, extraction, filtering and decontamination.

Nothing else in the library imports this subpackage. ``queries()`` and ``oracle_sql()`` in
:mod:`strandloom.llm.queries` list what the driver registers.
"""
