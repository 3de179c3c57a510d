"""Exceptions raised while a plan is built; row-level faults use raise_error or NULL."""


class UnsupportedInputError(Exception):
    """An option names something the library does not offer."""


class ZeroVectorError(Exception):
    """A line was given by two equal points."""


class InvalidPolygonError(Exception):
    """A polygon has too few vertices or crosses itself."""


class EmptyError(Exception):
    """An input that must have rows has none."""


class MissingParameterError(Exception):
    """A parameter that the chosen option needs was not given."""


class KeyExistError(Exception):
    """A key that must be new is there already."""


class KeyNotExistError(Exception):
    """A key that must exist is missing."""


class OutOfRangeError(Exception):
    """A number lies outside its range."""


class SolverNotAvailableError(Exception):
    """The method is known but not built."""
