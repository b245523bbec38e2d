"""One error type for rejected calls, with a stable code."""

from __future__ import annotations


class OpError(ValueError):
    """A call that is rejected before it runs: code, message, and what would have been possible."""

    def __init__(self, code: str, message: str, path: str = "", **details):
        super().__init__(f"{code}: {message}" + (f" (at {path})" if path else ""))
        self.code, self.path, self.details = code, path, details

    def feedback(self) -> dict:
        return {"code": self.code, "path": self.path, "message": str(self), **self.details}


def feedback_of(error: Exception) -> dict:
    """Structured feedback for our errors and for Spark's own conditions."""
    if isinstance(error, OpError):
        return error.feedback()
    condition = getattr(error, "getCondition", lambda: None)() or type(error).__name__
    return {"code": condition.lower(), "path": "", "message": str(error).split("\n")[0]}
