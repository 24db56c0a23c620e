"""Errors of control calls, and the text form of a status."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the status codes.
LABELS = {"ok": "ok", "not_found": "not found", "corruption": "corruption", "io_error": "io error", "invalid_argument": "invalid argument"}


class StoreError(Exception):
    code = "io_error"

    def __str__(self) -> str:
        return status_line(self.code, super().__str__())


class NotFound(StoreError):
    code = "not_found"


class Corruption(StoreError):
    code = "corruption"


class InvalidArgument(StoreError):
    code = "invalid_argument"


class Closed(StoreError):
    code = "io_error"


def status_line(code: str, message: str = "") -> str:
    return LABELS[code] + (f": {message}" if message and code != "ok" else "")


def status_text(code: Column, message: Column) -> Column:
    """The same for columns: 'ok', or the label and, if any, the message."""
    label = F.lit(None).cast("string")
    for name, text in LABELS.items():
        label = F.when(code == name, text).otherwise(label)
    tail = F.when((code != "ok") & (F.length(F.coalesce(message, F.lit(""))) > 0), F.concat(F.lit(": "), message)).otherwise("")
    return F.concat(label, tail)
