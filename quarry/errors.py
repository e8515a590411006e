"""Errors that callers may want to tell apart."""


class QuarryError(Exception):
    """Anything this engine reports about its input or state."""


class IndexingError(QuarryError):
    pass


class RetrievalError(QuarryError):
    pass


class DatasetError(QuarryError):
    pass


class GenerationError(QuarryError):
    pass


class EvaluationError(QuarryError):
    pass
