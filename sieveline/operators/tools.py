"""Tools by name: a registry of functions whose failures are answers."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any


class Tools:
    """Functions by name. run() gives a tool's result; a name that isn't known
    and whatever a tool raises become text, so that a session goes on."""

    def __init__(self, known: Mapping[str, Callable[..., Any]]) -> None:
        self.known = dict(known)

    def run(self, name: str, args: Any = None) -> Any:
        tool = self.known.get(name)
        if tool is None:
            return f"unknown tool {name}"
        try:
            return tool(**args) if isinstance(args, dict) else tool()
        except Exception as e:  # noqa: BLE001
            return f"error: {e}"
