"""kgrec: knowledge-graph-aware recommendation as Spark DataFrame operators.

Sub-packages
------------
sources    readers for the driver tables, TSV / atomic files, JSON documents, vector stores; sinks
functions  column-expression builders (text cleaning, completion parser, vector math, hashing)
operators  the pipeline operators (prompts, triples, graph, vectors, neighbours, training, rank, metrics, runs)
plans      the registered query catalogue and its DuckDB oracle SQL
streaming  a Structured Streaming front for the batch completion job
"""

__version__ = "0.1.0"
