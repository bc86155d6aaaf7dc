"""Failures of one document; classes match the `errors` table."""


class PdfError(Exception):
    kind = "malformed"

    def __init__(self, message: str, at: int = -1):
        super().__init__(message if at < 0 else f"{message} at byte {at}")


class LimitError(PdfError):
    kind = "limit"


class UnsupportedError(PdfError):
    kind = "unsupported"


class MissingKey(PdfError):
    pass
