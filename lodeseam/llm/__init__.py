"""Operations of a training-data pipeline over a ``documents`` table, one module per operation.

Nothing outside this package imports it.  ``lodeseam.llm.registry`` lists the queries.
"""
