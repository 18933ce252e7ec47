"""Registered queries over the given tables, each with its SQL equivalent where one exists."""

from __future__ import annotations

from checks import chat, docs, edits, grids, ocr, packages, people, web

GROUPS = (chat, people, docs, grids, packages, ocr, web, edits)


def queries() -> dict:
    return {name: run for group in GROUPS for name, run in group.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for group in GROUPS for name, sql in group.ORACLE.items()}
