"""Errors, each with the exit code that the command line ends with."""


class EngineError(Exception):
    exit_code = 1


class ConfigError(EngineError):
    """Wrong options, missing paths, circular includes."""

    exit_code = 1


class ParseError(EngineError):
    """A script that is not in the language."""

    exit_code = 2


class UnsupportedOperation(EngineError):
    """An unknown language, or a module and action that don't go together."""

    exit_code = 3


class SourceError(EngineError):
    """A file that can't be read or written, or isn't UTF-8."""

    exit_code = 4


#: ``--check`` found files that would change.
WOULD_CHANGE = 10
