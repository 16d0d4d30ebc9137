"""Imports every query module, so that the registry is full."""

import importlib
import pkgutil

import framewright.plans as plans

for module in pkgutil.iter_modules(plans.__path__):
    if module.name.startswith("on_"):
        importlib.import_module(f"framewright.plans.{module.name}")
