"""Operators for preparing language-model training data.

One module per operator; ``queries.py`` registers the thin ``opN_<name>``
queries and ``sql.py`` holds their DuckDB SQL twins.  Nothing outside this
subpackage and ``corpus_pipeline.py`` imports it.
"""
