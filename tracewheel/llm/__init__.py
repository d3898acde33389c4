"""Training-data operators: ten corpus-scale components on DataFrames.

Nothing outside this package imports it; ``tracewheel.llm.registry`` lists its
queries and their SQL.
"""
