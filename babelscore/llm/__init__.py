"""Training-data operators: ten corpus operations written as Spark jobs.

Nothing outside this folder imports it. Each module holds one operator with its own interface;
``queries.py`` holds the thin registered queries and their SQL.
"""
