"""Methods by name: the surface by which users add their own neighbour searches, kernels, Laplacians, losses and optimizers."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Named callables of one kind; ``auto`` stands for the default one."""

    def __init__(self, kind: str):
        self.kind = kind
        self._methods: dict[str, Callable] = {}
        self._default: str | None = None

    def register(self, name: str, default: bool = False) -> Callable:
        """Decorator that adds a method under ``name``."""

        def add(function: Callable) -> Callable:
            self._methods[name] = function
            if default:
                self._default = name
            return function

        return add

    def unregister(self, name: str) -> None:
        del self._methods[self.resolve(name)]

    def names(self) -> list[str]:
        return sorted(self._methods)

    def resolve(self, name: str) -> str:
        chosen = self._default if name == "auto" else name
        if chosen not in self._methods:
            raise ValueError(f"unknown {self.kind} method {name!r}; there are {', '.join(['auto', *self.names()])}")
        return chosen

    def get(self, name: str) -> Callable:
        return self._methods[self.resolve(name)]
