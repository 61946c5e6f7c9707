"""Operations for building large text-training corpora, one module per operation.

Nothing else in the library imports this subpackage.  ``queries.py`` holds the registered
queries over whole tables, ``oracles.py`` the SQL twins where SQL can express a query.
"""
