"""Interval analytics for genomic tables, written as plain Spark jobs.

Layout
------
``sources``    readers (text lines -> typed tables) and writers
``functions``  column expressions (flags, CIGAR, sequence, variants, loci)
``operators``  table-level operators: joins, aggregates, scans, packing, ranking
``plans``      interval views over the benchmark tables and the named queries
``scale``      ordered scans, order statistics and sampling that never put a
               whole chromosome or a whole group into one task
"""

__version__ = "0.1.0"
