"""The registered queries: each operator on the benchmark tables, with its SQL twin."""

from mandigrid.queries import (
    addresses, catalogue, cleaning, files, matching, plans, quality, reference, rollups, serving,
    streaming, timeseries,
)

MODULES = (rollups, catalogue, quality, timeseries, serving, cleaning, matching, addresses, reference,
           plans, streaming, files)


def all_queries():
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def all_sql():
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
