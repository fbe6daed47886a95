"""Errors of query validation and execution."""


class QueryError(ValueError):
    """A query that cannot be run; ``code`` names the reason."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code
