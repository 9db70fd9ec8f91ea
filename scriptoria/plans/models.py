"""Summarisers: the protocol, an HTTP client for chat completions, and a deterministic stand-in."""

from __future__ import annotations

import json
import time
import urllib.request
from typing import Protocol

from scriptoria.functions.sanitize import sanitize_text
from scriptoria.functions.vocabulary import MERGE_INSTRUCTIONS, PROMPTS, SYSTEM_PROMPT


class Summariser(Protocol):
    """Answers a prompt of a kind; must be picklable, one instance is made per task."""

    def summarise(self, text: str, kind: str, system: str = SYSTEM_PROMPT) -> str: ...


class Extractive:
    """The first words of the text: what a model is replaced by in tests and dry runs."""

    def __init__(self, words: int = 12) -> None:
        self.words = words

    def summarise(self, text: str, kind: str, system: str = SYSTEM_PROMPT) -> str:
        return " ".join(text.removeprefix(MERGE_INSTRUCTIONS).split()[: self.words])


class HttpModel:
    """A chat-completions endpoint: fixed temperature and output limit, some attempts with a pause, sanitised answers."""

    def __init__(self, url: str, model: str = "local", temperature: float = 0.3, max_tokens: int = 256, attempts: int = 3, pause: float = 1.0, timeout: float = 120.0) -> None:
        self.url, self.model, self.temperature, self.max_tokens = url, model, temperature, max_tokens
        self.attempts, self.pause, self.timeout = attempts, pause, timeout

    def ping(self) -> bool:
        """Whether the endpoint answers within two seconds."""
        try:
            with urllib.request.urlopen(self.url.rsplit("/v1/", 1)[0], timeout=2):  # noqa: S310
                return True
        except OSError:
            return False

    def summarise(self, text: str, kind: str, system: str = SYSTEM_PROMPT) -> str:
        prompt = PROMPTS.get(kind, PROMPTS["module"]).replace("{text}", text)
        body = {"model": self.model, "temperature": self.temperature, "max_tokens": self.max_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})  # noqa: S310
        failure: Exception | None = None
        for n in range(self.attempts):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
                    return sanitize_text(json.load(answer)["choices"][0]["message"]["content"])
            except (OSError, ValueError, KeyError, IndexError) as e:
                failure = e
                if n + 1 < self.attempts:
                    time.sleep(self.pause)
        raise RuntimeError(f"no answer after {self.attempts} attempts: {failure}")
