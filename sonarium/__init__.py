"""Model-evaluation analytics as PySpark DataFrame operators.

Layout
------
``functions``  column expressions (no shuffle, no state)
``operators``  DataFrame -> DataFrame operators
``sources``    metadata files, audio files, dataset and result tables
``streaming``  Structured Streaming forms of the stateful operators
``plans``      the registered queries, each with its check in SQL
"""
