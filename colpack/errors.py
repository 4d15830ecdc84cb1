"""Error classes.  A strict operator raises them, a try_ operator returns their code."""


class ColpackError(Exception):
    code = "ERROR"

    def __init__(self, message: str = ""):
        super().__init__(f"[{self.code}] {message}" if message else f"[{self.code}]")


class EmptyInput(ColpackError):
    """Blocks and arrays have at least one byte or element; only streams may be empty."""

    code = "EMPTY_INPUT"


class CorruptedData(ColpackError):
    code = "CORRUPTED_DATA"


class InvalidParameter(ColpackError):
    code = "INVALID_PARAMETER"


class TypeMismatch(ColpackError):
    code = "TYPE_MISMATCH"


class ContextClosed(ColpackError):
    code = "CONTEXT_CLOSED"
