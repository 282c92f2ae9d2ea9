"""Who rewrites a page's text: providers in order of preference, with failover, and the plain text where none answers.

No provider is built in; a provider is any function of a prompt that returns text or raises.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

Provider = Callable[[str], str]
#: Statuses that are tried again, and the longest wait between tries.
RETRIED, LONGEST_MS = (429, 500, 502, 503, 504), 3000


class Refused(Exception):
    """A provider's failure with its status; ``after_ms`` is the wait it asks for."""

    def __init__(self, status: int, after_ms: int | None = None):
        super().__init__(f"status {status}")
        self.status, self.after_ms = status, after_ms


@dataclass(frozen=True)
class Rewritten:
    text: str
    provider: str | None
    failures: tuple[tuple[str, str], ...] = ()


def chain(preference: str, available: dict[str, Provider]) -> list[str]:
    """The names to ask in order: the preferred one first, with Auto as they were given; unknown preferences leave the order."""
    names = list(available)
    return names if preference == "Auto" or preference not in available else [preference, *[n for n in names if n != preference]]


def ask(provider: Provider, prompt: str, retries: int = 3, base_ms: int = 500, wait: Callable[[int], None] = lambda ms: None) -> str:
    """A provider's answer; retried statuses wait twice as long each time, or as long as they ask for, but never more than LONGEST_MS."""
    for attempt in range(retries + 1):
        try:
            return provider(prompt)
        except Refused as refused:
            if refused.status not in RETRIED or attempt == retries:
                raise
            wait(min(LONGEST_MS, refused.after_ms if refused.after_ms is not None else base_ms * 2**attempt))
    raise AssertionError


def rewrite(plain: str, prompt: str, preference: str, available: dict[str, Provider], wait: Callable[[int], None] = lambda ms: None) -> Rewritten:
    """The first provider's answer that is not empty, or else the plain text, with what failed and why."""
    failures = []
    for name in chain(preference, available):
        try:
            text = ask(available[name], prompt, wait=wait)
        except Exception as problem:  # noqa: BLE001  the next one is asked
            failures.append((name, str(problem)))
            continue
        if text.strip():
            return Rewritten(text, name, tuple(failures))
        failures.append((name, "empty answer"))
    return Rewritten(plain, None, tuple(failures))
