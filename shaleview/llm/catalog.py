"""All queries of this folder by name, with their SQL."""

from importlib import import_module

MODULES = ["lookalikes", "leakage", "history", "survivors", "names", "addresses", "individuals", "scans", "personal", "mixing"]
QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _m = import_module(f".{_name}", __package__)
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
