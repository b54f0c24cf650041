"""Query plans over the evaluation views."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every query module so that its queries are registered."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module.startswith("queries_"):
            importlib.import_module(f"{__name__}.{module}")
