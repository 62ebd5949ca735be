"""Engines for `review` that talk to a service by a function which the user brings.

`send` takes a request and gives the reply, both as JSON objects: a client's call, a
batch job's, a test's. Nothing here opens a connection. Two dialects are known: a
reply that must call a tool, and one whose text is in a format.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from .. import schema as S
from ..operators.document import Document, EditError
from .review import Interrupted, Truncated, render, segment

NAME, ABOUT = "emit_plan", "The changes that are proposed, as action items."
#: What a service says of a call that it doesn't know the sender of, in lower case.
UNKNOWN_SENDER = ("401", "403", "api key", "api_key", "authentication", "credential", "permission", "unauthorized")


class Credentials(EditError):
    """The service doesn't know who asks; to ask again is no use, so this isn't retried."""


@dataclass
class Reply:
    payload: dict
    model: str
    usage: dict[str, int] = field(default_factory=dict)
    stop: str = ""


@dataclass
class Engine:
    """Asks for an object of a schema; `usage` adds up what all calls took."""

    send: Callable[[dict], dict]
    model: str | None = None
    system: str = "You review documents and propose changes as a plan of actions."
    usage: dict[str, int] = field(default_factory=dict)

    def request(self, prompt: str, name: str, about: str, schema: Callable[[str], dict], max_tokens: int) -> dict:
        raise NotImplementedError

    def read(self, reply: dict) -> Reply:
        raise NotImplementedError

    def ask(self, prompt: str, name: str, about: str, schema: Callable[[str], dict], max_tokens: int, on_event: Callable | None = None) -> Reply:
        try:
            answer = self.send(self.request(prompt, name, about, schema, max_tokens))
        except Credentials:
            raise
        except (ConnectionResetError, EOFError) as why:
            raise Interrupted(f"the reply broke off: {why}") from why
        except Exception as why:
            if isinstance(why, PermissionError) or any(x in str(why).lower() for x in UNKNOWN_SENDER):
                raise Credentials(f"the service doesn't know the sender: {why}") from why
            raise RuntimeError(str(why)) from why
        if on_event:
            on_event("reply")
        reply = self.read(answer)
        for k, n in reply.usage.items():
            self.usage[k] = self.usage.get(k, 0) + n
        return reply

    def emit(self, prompt: str, max_tokens: int, on_event: Callable | None = None) -> list[dict]:
        items = self.ask(prompt, NAME, ABOUT, S.action_json_schema, max_tokens, on_event).payload.get("action_items")
        if not isinstance(items, list):
            raise RuntimeError("the reply has no action items")
        return [{k: v for k, v in x.items() if v is not None} for x in items]

    def decide(self, prompt: str, schema: dict, max_tokens: int) -> dict:
        return self.ask(prompt, "choose_segments", "What is to be read, and how.", lambda _: schema, max_tokens).payload


def _counts(usage: dict | None, names: dict[str, tuple[str, ...]]) -> dict[str, int]:
    """Numbers of a reply's usage under one set of names; what it doesn't say is 0."""
    def at(path: tuple[str, ...]) -> int:
        now: object = usage
        for k in path:
            now = now.get(k) if isinstance(now, dict) else None
        return int(now) if isinstance(now, (int, float)) else 0

    return {n: at(path) for n, path in names.items()} if usage else {}


class ToolEngine(Engine):
    """The reply is the input of a tool that it must call."""

    def request(self, prompt, name, about, schema, max_tokens):
        return {"model": self.model, "max_tokens": max_tokens, "system": self.system, "messages": [{"role": "user", "content": prompt}], "tools": [S.output_form(name, about, schema("inline"))], "tool_choice": {"type": "tool", "name": name}}

    def read(self, reply):
        stop = str(reply.get("stop_reason") or "")
        if stop == "refusal":
            raise RuntimeError(f"the engine declined: {reply.get('stop_details') or 'no reason given'}")
        if stop == "max_tokens":  # what it called the tool with is cut off as well
            raise Truncated("the reply ended at its limit of tokens")
        payload = next((b.get("input") for b in reply.get("content") or () if b.get("type") == "tool_use"), None)
        if not isinstance(payload, dict):
            raise RuntimeError(f"the reply calls no tool (it stopped for {stop or 'no reason given'})")
        names = {"input": ("input_tokens",), "output": ("output_tokens",), "cached": ("cache_read_input_tokens",)}
        return Reply(payload, reply.get("model") or self.model or "", _counts(reply.get("usage"), names), stop)


class TextEngine(Engine):
    """The reply is text, in a format that a schema gives."""

    def request(self, prompt, name, about, schema, max_tokens):
        return {"model": self.model, "max_output_tokens": max_tokens, "instructions": self.system, "input": prompt, "text": S.output_form(name, about, schema("anyOf"), "text")}

    def read(self, reply):
        blocks = [b for x in reply.get("output") or () for b in x.get("content") or ()]
        if refused := [b for b in blocks if b.get("type") == "refusal"]:
            raise RuntimeError(f"the engine declined: {refused[0].get('refusal') or 'no reason given'}")
        if reply.get("status") == "incomplete":
            why = (reply.get("incomplete_details") or {}).get("reason") or "unknown"
            raise (Truncated if why == "max_output_tokens" else RuntimeError)(f"the reply is incomplete: {why}")
        text = "".join(b.get("text") or "" for b in blocks if b.get("type") == "output_text")
        if not text.strip():
            raise RuntimeError(f"the reply is empty (status {reply.get('status')})")
        try:
            payload = json.loads(text)
        except ValueError as why:
            raise RuntimeError(f"the reply isn't JSON: {why}") from why
        names = {"input": ("input_tokens",), "output": ("output_tokens",), "cached": ("input_tokens_details", "cached_tokens")}
        return Reply(payload, reply.get("model") or self.model or "", _counts(reply.get("usage"), names), str(reply.get("status") or ""))


@dataclass
class WholeReviewer:
    """A document in one call; long ones are for `review.Reviewer`."""

    engine: object
    max_tokens: int = 16_000

    def propose(self, doc: Document, brief: str = "") -> list[dict]:
        text = "\n".join(render(s.blocks) for s in segment(doc, S.SEGMENT_TOKENS))
        return self.engine.emit(f"{brief}\n\n{text}", self.max_tokens)


def doctor(engine: object) -> str:
    """One small call with a clock on it; what keeps it from working is raised."""
    import time

    began = time.monotonic()
    items = engine.emit("Propose no changes: this only tries whether you can be reached.\n\n1. Nothing", 1_000)
    return f"{type(engine).__name__} ({getattr(engine, 'model', None) or 'its own model'}): {len(items)} items in {time.monotonic() - began:.1f} s"
