"""Errors with a code that names what was wrong."""


class AnalysisError(ValueError):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


def require(condition: bool, code: str, message: str = "") -> None:
    if not condition:
        raise AnalysisError(code, message)


def ordered_range(value, code: str = "BadRange") -> tuple[float, float] | None:
    """None, or two finite numbers in order."""
    if value is None:
        return None
    try:
        low, high = (float(x) for x in value)
    except (TypeError, ValueError):
        raise AnalysisError(code, f"{value!r} is not a pair of numbers") from None
    require(abs(low) < float("inf") and abs(high) < float("inf") and low <= high, code, f"{value!r} is not a finite range in order")
    return low, high


def positive(value, code: str) -> float | None:
    """None, or a finite number above 0."""
    if value is None:
        return None
    require(isinstance(value, (int, float)) and 0 < value < float("inf"), code, f"{value!r} is not a positive number")
    return float(value)
