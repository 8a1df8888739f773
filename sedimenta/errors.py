"""Errors that users of a session see."""


class EngineError(Exception):
    """Base of all errors raised on purpose."""


class AnalysisError(EngineError):
    """A statement that is understood but not valid."""


class UnsupportedStatement(AnalysisError):
    pass


class DatabaseNotFound(EngineError):
    pass


class SchemaNotFound(EngineError):
    pass


class TableNotFound(EngineError):
    pass


class StreamNotFound(EngineError):
    pass


class FunctionNotFound(EngineError):
    pass


class AlreadyExists(EngineError):
    pass


class NotEmpty(EngineError):
    pass


class AmbiguousRelation(EngineError):
    """A name that both a table and a stream have."""


class PermissionDenied(EngineError):
    def __init__(self, user: str, action: str):
        super().__init__(f"user {user} may not {action}")
        self.user, self.action = user, action


class TransactionConflict(EngineError):
    """A table changed since the transaction or statement read it."""


class StreamConcurrentConsume(EngineError):
    """Another consumer moved the stream's offset first."""


class StreamPayloadMissing(EngineError):
    """Files of a change record are gone or short."""


class StreamStale(EngineError):
    """Changes after the stream's offset are past retention."""
