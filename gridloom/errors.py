"""Errors of the query engine."""


class QueryError(Exception):
    """Any failure of a query."""

    kind = "query"

    def __str__(self) -> str:
        return f"{self.kind} error: {super().__str__()}"


class ParseError(QueryError):
    kind = "parse"


class PlanError(QueryError):
    kind = "plan"


class ExecutionError(QueryError):
    kind = "execution"


class DataSourceError(QueryError):
    kind = "data source"


class UnsupportedError(QueryError):
    kind = "not implemented"
