"""Typed errors of the engine."""

import re


class QuernError(Exception):
    """Base class; ``details`` carries machine-readable context."""

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details

    @property
    def code(self) -> str:
        """Name of the kind of error for machines, such as INVALID_FILTER."""
        return re.sub(r"(?<!^)(?=[A-Z])", "_", type(self).__name__).upper()

    def as_dict(self) -> dict:
        return {"code": self.code, "message": str(self), "details": self.details}


class EmbedderError(QuernError):
    """The embedder failed."""


class EmbedderUnavailable(EmbedderError):
    """The embedder could not be loaded."""


class EmbeddingFailed(EmbedderError):
    """A text could not be embedded."""


class SecurityError(QuernError):
    """Unsafe input."""


class InvalidFilter(SecurityError):
    """A filter is empty, too long or has characters that are not allowed."""


class InvalidId(SecurityError):
    """An id has characters that are not allowed or is too long."""


class PathOutsideRoot(SecurityError):
    """A path leaves the root."""


class GraphError(QuernError):
    """The graph is inconsistent."""


class DimensionMismatch(QuernError):
    """Vectors of different lengths were compared."""


class Conflict(QuernError):
    """Another writer has changed the store."""


class Closed(QuernError):
    """The engine takes no more work."""
