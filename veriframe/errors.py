"""Exceptions raised while a plan is being built (never for a single bad row)."""


class RuleError(ValueError):
    """A rule cannot be turned into a boolean Spark expression, or may not be run."""


class SourceError(ValueError):
    """A source or sink is not configured well enough to be read or written."""


class MetadataError(ValueError):
    """Rule metadata is missing or malformed."""
