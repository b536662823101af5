"""Typed errors; an unsupported shape raises, it is never approximated."""


class GraphError(ValueError):
    """Base of all errors of this package; ``code`` groups them."""

    code = "E100"

    def __init__(self, message: str):
        super().__init__(f"[{self.code}] {message}")


class SyntaxProblem(GraphError):
    code = "E107"


class TypeProblem(GraphError):
    code = "E201"


class SchemaProblem(GraphError):
    code = "E301"


class Unsupported(GraphError):
    code = "E108"
