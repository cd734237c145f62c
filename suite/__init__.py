"""The registered queries and their SQL twins."""

from . import cards, cleaning, errors, features, injection, metrics, reports, tables

MODULES = (tables, cleaning, features, injection, errors, cards, metrics, reports)


def all_queries():
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def all_sql():
    return {name: text for module in MODULES for name, text in module.SQL.items()}
