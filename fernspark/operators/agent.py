"""The agent loop on the driver: a model, tools, hooks and a message history, with stop, failure, feedback and retry rules."""

from __future__ import annotations

import json
import os
import subprocess
from collections import Counter
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

HOOKS = ("before_all", "on_start", "before_completion", "after_completion", "before_tool", "after_tool", "after_each", "on_new_message", "on_stream", "on_stop")
PENDING, RUNNING, STOPPED = "pending", "running", "stopped"


class AgentError(RuntimeError):
    pass


class FeedbackRequired(Exception):
    """A tool needs a human's answer; its call stays open."""


@dataclass(frozen=True)
class Output:
    """What a tool gives: ``text``, ``stop``, ``fail`` or ``agent_failed``."""

    text: Any = None
    kind: str = "text"


@dataclass(frozen=True)
class Tool:
    """A function of JSON arguments, with the schema that the model sees."""

    name: str
    run: Callable[..., Any]
    description: str = ""
    parameters: dict = field(default_factory=lambda: {"type": "object", "properties": {}})

    @property
    def spec(self) -> dict:
        return {"name": self.name, "description": self.description, "parameters": self.parameters}


def tool(description: str = "", **parameters: dict) -> Callable[[Callable[..., Any]], Tool]:
    """A function as a tool; parameters are JSON Schemas by name."""

    def make(f: Callable[..., Any]) -> Tool:
        return Tool(f.__name__, f, description or (f.__doc__ or "").strip(), {"type": "object", "properties": parameters, "required": sorted(parameters)})

    return make


def stop_tool() -> Tool:
    return Tool("stop", lambda **_: Output(None, "stop"), "Ends the task, finished or not.")


def stop_with_args(schema: dict | None = None) -> Tool:
    """Ends with an output: the ``output`` argument, or all arguments where a schema is given."""
    shape = schema or {"type": "object", "properties": {"output": {}}, "required": ["output"]}
    return Tool("stop", lambda **a: Output(a if schema else a["output"], "stop"), "Ends the task with its result.", shape)


def can_fail() -> Tool:
    shape = {"type": "object", "properties": {"reason": {"type": "string"}}, "required": ["reason"]}
    return Tool("task_failed", lambda reason="": Output(reason, "agent_failed"), "Gives the task up and says why.", shape)


def needs_approval(inner: Tool, approved: Callable[[dict], bool | None]) -> Tool:
    """The tool behind a human's word: None asks for it, False refuses."""

    def run(**args: Any) -> Any:
        said = approved(args)
        if said is None:
            raise FeedbackRequired(inner.name)
        return inner.run(**args) if said else Output("The call was refused.", "text")

    return Tool(inner.name, run, inner.description, inner.parameters)


def tools_allowed(tools: list[Tool], white: set[str] | None = None, black: set[str] | None = None) -> list[Tool]:
    return [t for t in tools if (white is None or t.name in white) and t.name not in (black or ())]


def same_call(call: dict) -> str:
    try:
        args = json.dumps(json.loads(call.get("args") or "{}"), sort_keys=True)
    except ValueError:
        args = call.get("args") or ""
    return f"{call['name']}:{args}"


@dataclass
class Agent:
    """``query`` adds a user's message and runs until the assistant has nothing to do, a tool stops it, or ``limit`` completions."""

    model: Any
    tools: list[Tool] = field(default_factory=list)
    system: str | None = None
    hooks: dict[str, list[Callable[..., None]]] = field(default_factory=dict)
    limit: int | None = None
    retries: int = 3
    stop_on_assistant: bool = True
    history: list[dict] = field(default_factory=list)
    state: str = PENDING
    reason: Any = None
    failures: Counter = field(default_factory=Counter)

    def on(self, event: str, f: Callable[..., None]) -> Agent:
        if event not in HOOKS:
            raise AgentError(f"an unknown hook {event}")
        self.hooks.setdefault(event, []).append(f)
        return self

    def _tell(self, event: str, *args: Any) -> None:
        for f in self.hooks.get(event, []):
            f(self, *args)

    def add(self, message: dict) -> None:
        self._tell("on_new_message", message)
        self.history.append(message)

    def context(self) -> list[dict]:
        """Messages since the last summary, and system messages before."""
        last = max((i for i, m in enumerate(self.history) if m["role"] == "summary"), default=-1)
        return [m for i, m in enumerate(self.history) if i >= last or m["role"] == "system"]

    def open_calls(self) -> list[dict]:
        done = {m["call_id"] for m in self.history if m["role"] == "tool"}
        return [c for m in self.history[-1 - next((i for i, m in enumerate(reversed(self.history)) if m.get("tool_calls")), len(self.history)) :] for c in m.get("tool_calls") or [] if c["id"] not in done]

    def query(self, text: str) -> Any:
        return self.run(text)

    def query_once(self, text: str) -> Any:
        return self.run(text, once=True)

    def run(self, text: str | None = None, once: bool = False) -> Any:
        if self.state == PENDING:
            self._tell("before_all")
            if self.system:
                self.add({"role": "system", "text": self.system})
        self.state, self.reason = RUNNING, None
        if text is not None:
            self.add({"role": "user", "text": text})
        if pending := self.open_calls():
            self._invoke(pending)
        self._tell("on_start")
        done = 0
        while self.state == RUNNING:
            last = self.history[-1] if self.history else None
            if last is None or self.open_calls() or (last["role"] == "assistant" and self.stop_on_assistant and done):
                self.stop("feedback" if self.open_calls() else "done")
                break
            if self.limit is not None and done >= self.limit:
                raise AgentError(f"over {self.limit} completions")
            self._step()
            done += 1
            if once:
                break
        return self.reason

    def stop(self, reason: Any = "requested") -> None:
        self.state, self.reason = STOPPED, reason
        self._tell("on_stop", reason)

    def _step(self) -> None:
        request = self.context()
        self._tell("before_completion", request)
        answer = self.model.complete(request, [t.spec for t in self.tools])
        self._tell("after_completion", answer)
        calls = [dict(c) for c in answer.get("tool_calls") or []]
        self.add({"role": "assistant", "text": answer.get("content"), "tool_calls": calls})
        if calls:
            self._invoke(calls)
        self._tell("after_each")

    def _call(self, call: dict) -> Output:
        found = next((t for t in self.tools if t.name == call["name"]), None)
        if found is None:
            return Output(f"no tool {call['name']}", "fail")
        try:
            args = json.loads(call.get("args") or "{}")
            out = found.run(**args)
        except FeedbackRequired:
            return Output(None, "feedback")
        except Exception as e:  # noqa: BLE001  a tool's failure goes to the model
            return Output(f"{type(e).__name__}: {e}", "fail")
        return out if isinstance(out, Output) else Output(out)

    def _invoke(self, calls: list[dict]) -> None:
        """Calls run together; their outputs are taken in the order of the calls."""
        for c in calls:
            self._tell("before_tool", c)
        with ThreadPoolExecutor(max(1, len(calls))) as pool:
            outputs = list(pool.map(self._call, calls))
        for c, out in zip(calls, outputs, strict=True):
            self._tell("after_tool", c, out)
            if out.kind == "feedback":
                continue
            self.add({"role": "tool", "call_id": c["id"], "text": out.text if isinstance(out.text, str) else json.dumps(out.text), "kind": out.kind})
            if out.kind == "fail":
                self.failures[same_call(c)] += 1
                if self.failures[same_call(c)] > self.retries:
                    self.stop(("tool failed too often", c["name"]))
            elif out.kind in ("stop", "agent_failed"):
                self.stop((out.kind, out.text))


@dataclass(frozen=True)
class LocalExecutor:
    """Shell commands, reads and writes in a folder, with a time limit and a chosen environment."""

    folder: str
    timeout: float = 60.0
    env: dict[str, str] = field(default_factory=dict)
    clear_env: bool = False

    def _path(self, path: str) -> Path:
        return Path(path) if os.path.isabs(path) else Path(self.folder) / path

    def shell(self, command: str, timeout: float | None = None) -> tuple[int, str]:
        env = ({} if self.clear_env else dict(os.environ)) | self.env
        try:
            done = subprocess.run(["sh", "-c", command], cwd=self.folder, env=env, capture_output=True, text=True, errors="replace", timeout=timeout or self.timeout)
        except subprocess.TimeoutExpired as e:
            raise TimeoutError(f"{command} took over {e.timeout} s") from e
        return done.returncode, done.stdout + done.stderr

    def read(self, path: str) -> str:
        return self._path(path).read_text(errors="replace")

    def write(self, path: str, text: str) -> None:
        self._path(path).parent.mkdir(parents=True, exist_ok=True)
        self._path(path).write_text(text)

    def scoped(self, folder: str) -> LocalExecutor:
        """The same in a folder below."""
        return LocalExecutor(str(self._path(folder)), self.timeout, self.env, self.clear_env)
