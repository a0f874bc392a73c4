"""Errors of the portfolio engine; every one stops a job before anything is published."""


class EngineError(ValueError):
    """Base class."""


class ConfigError(EngineError):
    """A configuration value is missing, unknown or out of range."""


class InputError(EngineError):
    """An input table breaks its contract."""


class SolverError(EngineError):
    """An optimisation problem is infeasible or its solution fails the recheck."""


class RiskError(EngineError):
    """The risk model cannot be estimated from what is given."""
