"""Errors of the engine, beside Spark's own ``AnalysisException``."""


class EngineError(Exception):
    """Base of all errors raised by the engine itself."""


class ParseError(EngineError):
    """A statement that the front end cannot read."""


class NoSuchTable(EngineError):
    """A table that the catalog doesn't hold."""


class DuplicateTable(EngineError):
    """A table that the catalog holds already."""


class TypeMismatch(EngineError):
    """A value, column or schema of the wrong type."""


class MalformedData(EngineError):
    """Input rows that don't fit the declared schema."""


class FailedEmbedding(EngineError):
    """The embedder gave nothing, or vectors of the wrong size."""


class TransactionConflict(EngineError):
    """Another session committed a table that this transaction read or wrote."""


class IllegalTransaction(EngineError):
    """BEGIN inside a transaction, or COMMIT or ROLLBACK outside one."""
