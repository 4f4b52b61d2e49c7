"""The kinds of errors that the engine raises."""


class EngineError(Exception):
    """Base of all; ``kind`` is a stable name."""

    kind = "internal"


class InvalidArgument(EngineError, ValueError):
    kind = "invalid_argument"


class NotFound(EngineError, LookupError):
    kind = "not_found"


class AlreadyExists(EngineError):
    kind = "already_exists"


class FailedPrecondition(EngineError):
    kind = "failed_precondition"


class Internal(EngineError):
    kind = "internal"


class Aborted(EngineError):
    """Another writer came between; nothing was changed."""

    kind = "aborted"
