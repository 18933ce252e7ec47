"""Tiny helper so that a query and its SQL stand next to each other."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries = {}
        self.oracle = {}

    def add(self, name: str, sql: str | None = None):
        def register(run):
            self.queries[name] = run
            if sql is not None:
                self.oracle[name] = sql
            return run

        return register
