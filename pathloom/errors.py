"""Exceptions that callers can tell apart."""


class ValidationError(ValueError):
    """Input that an operator can't take."""


class ModelFitError(RuntimeError):
    """A model that could not be fitted."""


class ParityError(AssertionError):
    """Two results that should agree and don't."""
