"""State kept by a Python worker between tasks."""

from __future__ import annotations

import sys
import types


def kept(name: str, make):
    """The object made by make() the first time this worker process asks for name; name has to identify its contents."""
    holder = sys.modules.setdefault("_sedimenta_worker", types.ModuleType("_sedimenta_worker"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)
