"""Errors by name; each is one line to the caller."""


class ReconError(Exception):
    pass


class ConfigError(ReconError):
    pass


class UsageError(ReconError):
    pass


class NotFoundError(ReconError):
    pass


class EncodingDetectionError(ReconError):
    pass


class DelimiterDetectionError(ReconError):
    pass


class HeaderDetectionError(ReconError):
    pass


class DelimitedParseError(ReconError):
    pass


class XlsxReadError(ReconError):
    pass


class ParseSpecError(ReconError):
    pass


class UnrecognizedFormatError(ReconError):
    pass


class DriftError(ReconError):
    pass


class SchemaMismatchError(ReconError):
    pass


class ManyToManyKeyError(ReconError):
    pass


class NumberFormatError(ReconError):
    pass
