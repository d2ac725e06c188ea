"""The catalogue of page checks: every module of this folder is imported and registers its own."""

from importlib import import_module
from pkgutil import iter_modules

from .registry import CHECKS, CheckDef, catalogue, page_findings, register_check

for _module in iter_modules(__path__):
    import_module(f"{__name__}.{_module.name}")

__all__ = ["CHECKS", "CheckDef", "catalogue", "page_findings", "register_check"]
