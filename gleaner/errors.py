"""Exceptions that callers may see."""


class ConfigError(Exception):
    """A configuration file is missing, unreadable or says something wrong."""


class EmbedderError(Exception):
    """The embedding service failed or answered nonsense."""


class EvalError(Exception):
    """A golden set can't be used."""


class StaleSchemaError(Exception):
    """A table lacks columns that this version writes."""


class StoreError(Exception):
    """A file of the database can't be read or written, or too many write at once."""
