"""Spark-native engine for structured semantic memory over text.

Core: ``operators`` (graph, reconciliation, retrieval, chains, evaluation, nested
records, references), ``functions`` (column expressions), ``sources``, ``plans``
(the registered queries) and ``streaming``.  The optional subpackage ``llm`` holds
the operators for training corpora; nothing outside it imports it.
"""
