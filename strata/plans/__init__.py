"""Named queries over the driver's tables."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Import every plan module, so that its queries register themselves."""
    for module in iter_modules(__path__):
        import_module(f"{__name__}.{module.name}")
