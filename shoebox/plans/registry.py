"""All queries of the core and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("pipeline", "catalog_queries")


def collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        try:
            out.update(getattr(import_module(f"shoebox.plans.{name}"), attribute))
        except ModuleNotFoundError as e:
            if e.name != f"shoebox.plans.{name}":
                raise
    return out
