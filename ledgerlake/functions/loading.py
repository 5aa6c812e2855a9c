"""User functions from modules: each names itself in ``MANIFEST`` and registers in ``register_functions``."""

from __future__ import annotations

import importlib
from types import ModuleType

from ledgerlake.functions import registry


class PluginError(ValueError):
    pass


def load(name: str | ModuleType) -> dict:
    """Import a module and let it register its functions; returns its manifest (name, version)."""
    module = importlib.import_module(name) if isinstance(name, str) else name
    manifest = getattr(module, "MANIFEST", None)
    if not isinstance(manifest, dict) or "name" not in manifest:
        raise PluginError(f"{module.__name__} has no MANIFEST with a name")
    if not hasattr(module, "register_functions"):
        raise PluginError(f"{module.__name__} has no register_functions")
    module.register_functions(registry.register)
    return manifest


def load_all(names: list[str]) -> list[dict]:
    return [load(n) for n in names]
