"""Registered queries."""
import importlib
import pkgutil


def load_all() -> None:
    """Import every ``q_*`` module so that its queries are registered."""
    for m in pkgutil.iter_modules(__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{m.name}")
