"""A query and its SQL under one name."""

from __future__ import annotations

from collections.abc import Callable

from clinflow.plans.fixtures import SQL


class Register:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, fixtures: bool = True) -> Callable:
        """Registers the function; sql: a SELECT, or `name AS (...), ... SELECT`, after the fixtures' views."""

        def put(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                body = sql.strip()
                if not fixtures:
                    self.sql[f.__name__] = body
                else:
                    joint = ", " if not body.upper().startswith("SELECT") else " "
                    self.sql[f.__name__] = f"WITH {SQL.strip()}{joint}{body}"
            return f

        return put
