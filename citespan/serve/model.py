"""A chat-completions client with the standard library, the summariser and the answerer built on it."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from .. import config
from .index import SERVER_TOOLS

FILE_TOKENS, DIR_TOKENS, TIMEOUT = 1200, 800, 60
MAX_TURNS = 40
SYSTEM = "Answer from the project's source only. Find files and symbols with the tools, read every region you rely on, and say so when the source doesn't hold the answer."


class ModelError(RuntimeError):
    pass


class Cancelled(RuntimeError):
    """A turn that its asker broke off."""


@dataclass(frozen=True)
class Model:
    """Where and how to ask; plain values, so that it can be sent to executors."""

    base_url: str
    model: str
    api_key: str | None = None
    timeout: int = TIMEOUT

    @classmethod
    def of(cls, section: str, model: str | None = None) -> Model:
        """By flag, environment, the section, [default], constants; a key has no constant."""
        c = config.load()
        key = config.resolve(c, section, "api_key", env=config.API_KEY_ENV)
        if key is None:
            raise ModelError(f"{config.API_KEY_ENV} not set and no api_key in {config.config_path()} [{section}] or [default]")
        return cls(config.resolve(c, section, "base_url", env=config.BASE_URL_ENV, fallback=config.DEFAULT_BASE_URL), config.resolve(c, section, "model", model, config.MODEL_ENV, config.DEFAULT_MODEL), key)

    def send(self, **body) -> dict:
        """The first choice's message."""
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/chat/completions", json.dumps({"model": self.model, **body}).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return json.load(r)["choices"][0]["message"]
        except (OSError, ValueError, KeyError, IndexError) as e:
            raise ModelError(f"request failed: {e}") from e

    def stream(self, on_text: Callable[[str, str], None], cancelled: Callable[[], bool] = lambda: False, **body) -> dict:
        """The first choice's message, put together from its events; on_text hears of each piece of reasoning and content.

        Where ``cancelled`` says so between two events, the connection is closed and Cancelled raised.
        """
        headers = {"Content-Type": "application/json", "Accept": "text/event-stream"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/chat/completions", json.dumps({"model": self.model, "stream": True, **body}).encode(), headers)
        message: dict = {"role": "assistant"}
        calls: dict[int, dict] = {}
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                for line in r:
                    if cancelled():
                        raise Cancelled("cancelled")
                    data = line.decode("utf-8", "replace").strip().removeprefix("data:").strip()
                    if not line.startswith(b"data:") or not data:
                        continue
                    if data == "[DONE]":
                        break
                    choices = json.loads(data).get("choices") or [{}]
                    delta = choices[0].get("delta") or {}
                    for kind in ("reasoning", "content"):
                        if delta.get(kind):
                            message[kind] = message.get(kind, "") + delta[kind]
                            on_text(kind, delta[kind])
                    for part in delta.get("tool_calls") or []:
                        call = calls.setdefault(part.get("index", 0), {"id": None, "type": "function", "function": {"name": "", "arguments": ""}})
                        call["id"] = part.get("id") or call["id"]
                        for key in ("name", "arguments"):
                            call["function"][key] += (part.get("function") or {}).get(key) or ""
        except (OSError, ValueError, KeyError, IndexError) as e:
            raise ModelError(f"request failed: {e}") from e
        return message | ({"tool_calls": [calls[i] for i in sorted(calls)]} if calls else {})

    def complete(self, prompt: str, max_tokens: int) -> str:
        """The answer at temperature 0; an empty one gives way to the reasoning, and nothing at all is an error."""
        message = self.send(messages=[{"role": "user", "content": prompt}], temperature=0, max_tokens=max_tokens)
        text = (message.get("content") or "").strip() or (message.get("reasoning") or "").strip()
        if not text:
            raise ModelError("empty response")
        return text


@dataclass(frozen=True)
class FileSummarizer:
    """For ``summaries.summarize``: three lines about a file."""

    model: Model

    def __call__(self, path: str, lang: str | None, content: str) -> str:
        return self.model.complete(f"Summarise this {lang or 'text'} file in exactly three lines: its purpose, its main parts, what it depends on.\n\nFile: {path}\n\n{content}", FILE_TOKENS)


@dataclass(frozen=True)
class DirSummarizer:
    """Two lines about a directory, of the prompt that ``summaries.dir_prompts`` makes."""

    model: Model

    def __call__(self, prompt: str) -> str:
        return self.model.complete(f"Summarise this directory in exactly two lines: its purpose, its main parts.\n\n{prompt}", DIR_TOKENS)


def answerer(model: Model, on_event: Callable[[str, object], None] = lambda kind, what: None, streaming: bool = False, cancelled: Callable[[], bool] = lambda: False) -> Callable[[str, Callable[..., dict]], str]:
    """An answerer for ``ask`` that lets the model call the tools until it answers.

    on_event hears of each tool call and response in order, and of thinking and text, piece by piece if
    streaming.  Where ``cancelled`` says so, before a request, a tool call or between two events, Cancelled
    is raised and the turn leaves nothing behind.
    """
    tools = [{"type": "function", "function": {"name": n, "parameters": schema}} for n, (schema, _) in SERVER_TOOLS.items()]

    def answer(question: str, call: Callable[..., dict]) -> str:
        messages: list[dict] = [{"role": "system", "content": SYSTEM}, {"role": "user", "content": question}]
        for _ in range(MAX_TURNS):
            if cancelled():
                raise Cancelled("cancelled")
            message = model.stream(on_event, cancelled, messages=messages, tools=tools) if streaming else model.send(messages=messages, tools=tools)
            messages.append(message)
            for kind in ("reasoning", "content"):
                if message.get(kind) and not streaming:
                    on_event(kind, message[kind])
            calls = message.get("tool_calls") or []
            if not calls:
                return message.get("content") or message.get("reasoning") or ""
            for c in calls:
                if cancelled():
                    raise Cancelled("cancelled")
                name = c["function"]["name"]
                try:
                    args = json.loads(c["function"].get("arguments") or "{}")
                    on_event("call", (name, args))
                    result = call(name, **args)
                except (TypeError, ValueError) as e:
                    result = {"error": f"bad arguments: {e}"}
                on_event("response", (name, result))
                messages.append({"role": "tool", "tool_call_id": c.get("id"), "content": json.dumps(result, ensure_ascii=False)})
        raise ModelError("the model kept calling tools")

    return answer


def configured(section: str = "chat", model: str | None = None) -> bool:
    """Whether there is a key to ask a model with."""
    try:
        Model.of(section, model)
    except ModelError:
        return False
    return os.environ.get("CITESPAN_OFFLINE") is None
