"""Errors that the engine raises on purpose; the command line turns them into exit code 1."""


class EngineError(Exception):
    """The base of all of them."""


class ConfigError(EngineError):
    """The configuration can't be read or contradicts itself."""


class ExtractionError(EngineError):
    """An input can't be read, or a backend's answer is of no use."""


class ValidationError(EngineError):
    """Records can't be validated at all (failing fields are no error: they are reported)."""


class DatabaseError(EngineError):
    """Tables are missing, cyclic or can't be written."""


class ReviewError(EngineError):
    """A revision failed."""
