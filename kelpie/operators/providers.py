"""Chat models by provider name. A provider turns options into a call(messages) -> (answer, tokens in, tokens out)."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

from kelpie.operators.answer import Budgeted, RateLimited

Call = Callable[[list[dict]], tuple[str, int, int]]
_PROVIDERS: dict[str, Callable[..., Call]] = {}


def provider(name: str):
    def register(f: Callable[..., Call]) -> Callable[..., Call]:
        _PROVIDERS[name] = f
        return f

    return register


def model(name: str, budgeted: bool = True, **options) -> Callable[[list[dict]], str]:
    """The chat function of a provider, with retries and a token cap, or bare."""
    if name not in _PROVIDERS:
        raise ValueError(f"no provider {name!r}; known: {sorted(_PROVIDERS)}")
    call = _PROVIDERS[name](**options)
    return Budgeted(call) if budgeted else lambda messages: call(messages)[0]


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310  the caller names the endpoint
            return json.load(answer)
    except urllib.error.HTTPError as e:
        if e.code == 429:
            raise RateLimited(e.read().decode("utf-8", "ignore")) from e
        raise


@provider("chat_completions")
def chat_completions(url: str, name: str, key: str = "", temperature: float = 0.0, max_tokens: int = 1024, timeout: float = 120) -> Call:
    """Any endpoint that speaks the chat-completions form, hosted or local."""

    def call(messages: list[dict]) -> tuple[str, int, int]:
        head = {"Authorization": f"Bearer {key}"} if key else {}
        got = _post(url, {"model": name, "messages": messages, "temperature": temperature, "max_tokens": max_tokens}, head, timeout)
        used = got.get("usage") or {}
        return got["choices"][0]["message"]["content"] or "", used.get("prompt_tokens", 0), used.get("completion_tokens", 0)

    return call


@provider("messages")
def messages_form(url: str, name: str, key: str = "", version: str = "2023-06-01", max_tokens: int = 1024, timeout: float = 120) -> Call:
    """Endpoints that take the system text apart from the turns."""

    def call(messages: list[dict]) -> tuple[str, int, int]:
        system = "\n".join(m["content"] for m in messages if m["role"] == "system")
        turns = [m for m in messages if m["role"] != "system"]
        got = _post(url, {"model": name, "system": system, "messages": turns, "max_tokens": max_tokens}, {"x-api-key": key, "anthropic-version": version}, timeout)
        used = got.get("usage") or {}
        return "".join(p.get("text", "") for p in got["content"]), used.get("input_tokens", 0), used.get("output_tokens", 0)

    return call


@provider("local_chat")
def local_chat(url: str, name: str, temperature: float = 0.0, timeout: float = 300) -> Call:
    """A local server with a chat route."""

    def call(messages: list[dict]) -> tuple[str, int, int]:
        got = _post(url, {"model": name, "messages": messages, "stream": False, "options": {"temperature": temperature}}, {}, timeout)
        return got["message"]["content"], got.get("prompt_eval_count", 0), got.get("eval_count", 0)

    return call


@provider("function")
def function(f: Callable[[list[dict]], str]) -> Call:
    """Any function of the messages: tests, or a client library of one's own (a cloud's runtime, a quota-bound host)."""
    return lambda messages: (f(messages), 0, 0)
