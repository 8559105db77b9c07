"""Inspection of untrusted text for Unicode carriers, as Spark DataFrame operators.

Public names are loaded when they are first used, so that workers import only what they run.
"""

from importlib import import_module

_WHERE = {"analyze": "operators.inspect", "inspect": "operators.inspect", "inspect_binary": "operators.inspect", "Limits": "settings", "Policy": "settings"}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(import_module(f"carrierlens.{_WHERE[name]}"), name)
