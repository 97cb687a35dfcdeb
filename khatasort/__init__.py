"""khatasort: statement categorization and training-data preparation on Spark.

The names of ``__all__`` are imported when they are first asked for, so that executors load only what they run.
"""

from importlib import import_module

__version__ = "0.2.0"

_WHERE = {
    "CATEGORIES": ("functions.fixed", "CATEGORIES"),
    "REVIEW_THRESHOLD": ("functions.fixed", "REVIEW"),
    "classify": ("operators.cascade", "classify"),
    "classify_native": ("operators.cascade", "classify_native"),
    "normalize_merchant": ("functions.text", "normalize_merchant"),
    "read_statement": ("sources.statement", "read_statement"),
    "Store": ("operators.learning", "Store"),
}
__all__ = [*_WHERE, "__version__"]  # noqa: PLE0604


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module, own = _WHERE[name]
    return getattr(import_module(f"{__name__}.{module}"), own)


def __dir__() -> list[str]:
    return sorted({*globals(), *__all__})
