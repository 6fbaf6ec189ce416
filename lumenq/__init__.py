"""lumenq: relational and semantic queries on Spark.

``lumenq.Session`` runs SQL with the semantic infix operators over versioned tables; ``lumenq.operators``
holds the same operators as DataFrame functions.
"""

__all__ = ["Session"]


def __getattr__(name: str):
    if name == "Session":
        from .session import Session

        return Session
    raise AttributeError(name)
