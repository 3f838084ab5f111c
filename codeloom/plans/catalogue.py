"""All registered queries and their SQL."""

from . import code_queries, corpus_queries, edit_queries, report_queries, table_queries  # noqa: F401
from .registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
