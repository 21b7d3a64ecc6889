"""Errors that users see. All are raised while a plan is built, before any task runs."""


class ArrayError(ValueError):
    """Base of all errors here."""


class ArrayNotFoundError(ArrayError, FileNotFoundError):
    pass


class GroupNotFoundError(ArrayError, FileNotFoundError):
    pass


class ContainsArrayError(ArrayError):
    pass


class ContainsGroupError(ArrayError):
    pass


class ChunkNotFoundError(ArrayError):
    pass


class BoundsError(ArrayError, IndexError):
    pass


class NegativeStepError(ArrayError, IndexError):
    pass


class SelectionError(ArrayError, IndexError):
    pass


class MetadataError(ArrayError):
    pass


class UnknownCodecError(MetadataError):
    pass
