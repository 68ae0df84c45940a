"""Training-data operators: ten corpus operators and the queries that apply them.

Nothing else in the library imports this subpackage. ``llm.queries`` has the query
functions and the SQL that checks them where SQL can express the operator.
"""
