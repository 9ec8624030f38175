"""Training-data operators: dedup, decontamination, sharding, mixing, scans, search, token output.

Nothing outside this subpackage imports it; ``queries()`` and ``oracle_sql()``
of :mod:`frameloom.llm.queries` are wired in by the driver entry module.
"""
