"""Task graphs on the driver: nodes, transitions, fan-out with an ordered join, pause and resume; and the same join over a table."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINISH = "__finish__"


class TaskError(RuntimeError):
    """A node failed or the graph is wrong; the whole task ends."""


@dataclass(frozen=True)
class Next:
    """Goes on to a node with a payload."""

    node: str
    value: Any = None


@dataclass(frozen=True)
class FanOut:
    """Starts a branch per (node, payload); ``join`` runs once all have come to it, with their payloads in the branches' order."""

    branches: tuple[tuple[str, Any], ...]
    join: str

    def and_(self, node: str, value: Any = None) -> FanOut:
        return FanOut((*self.branches, (node, value)), self.join)


@dataclass(frozen=True)
class Pause:
    """Holds the branch; a resumed task runs ``node`` with the payload."""

    node: str
    value: Any = None


@dataclass(frozen=True)
class Finish:
    value: Any = None


@dataclass
class _Branch:
    number: int
    node: str
    value: Any
    group: int | None = None  # of a fan-out
    place: int = 0


@dataclass
class _Group:
    join: str
    size: int
    got: dict[int, Any] = field(default_factory=dict)


@dataclass
class Task:
    """Nodes are functions of a payload that return a payload or a transition. Sequential tasks run one branch at a time, first come first
    served; parallel ones all at once. A payload alone follows the node's registered transition."""

    parallel: bool = False
    workers: int = 8
    nodes: dict[str, Callable[[Any], Any]] = field(default_factory=dict)
    edges: dict[str, Callable[[Any], Any]] = field(default_factory=dict)
    start: str | None = None
    paused: list[_Branch] = field(default_factory=list)
    _groups: dict[int, _Group] = field(default_factory=dict)
    _numbers: int = 0
    _input: Any = None
    current: list[str] = field(default_factory=list)

    def register(self, name: str, f: Callable[[Any], Any]) -> Task:
        if name in self.nodes:
            raise TaskError(f"two nodes {name}")
        self.nodes[name] = f
        return self

    def starts_with(self, name: str) -> Task:
        self.start = name
        return self

    def transition(self, name: str, f: Callable[[Any], Any] | str) -> Task:
        """What follows a node: a node's name, or a function of its output that returns a transition."""
        self.edges[name] = (lambda v: Next(f, v)) if isinstance(f, str) else f
        return self

    def finishes(self, name: str) -> Task:
        self.edges[name] = Finish
        return self

    def validate(self) -> None:
        if self.start is None or self.start not in self.nodes:
            raise TaskError("no start node")
        if unknown := [n for n in self.edges if n not in self.nodes]:
            raise TaskError(f"transitions from unknown nodes {unknown}")

    def reset(self) -> Any:
        """Runs again from the start with the last input."""
        return self.run(self._input)

    def run(self, value: Any = None) -> Any:
        self.validate()
        self._input, self.paused, self._groups, self._numbers = value, [], {}, 0
        return self._loop([self._branch(self.start, value)])

    def resume(self) -> Any:
        """Goes on with the paused branches in the order in which they were made."""
        if not self.paused:
            raise TaskError("nothing is paused")
        held, self.paused = sorted(self.paused, key=lambda b: b.number), []
        return self._loop(held)

    def _branch(self, node: str, value: Any, group: int | None = None, place: int = 0) -> _Branch:
        self._numbers += 1
        return _Branch(self._numbers, node, value, group, place)

    def _do(self, b: _Branch) -> Any:
        if b.node not in self.nodes:
            raise TaskError(f"no node {b.node}")
        try:
            out = self.nodes[b.node](b.value)
        except TaskError:
            raise
        except Exception as e:
            raise TaskError(f"{b.node}: {e}") from e
        if isinstance(out, Next | FanOut | Pause | Finish):
            return out
        if b.node not in self.edges:
            raise TaskError(f"no transition from {b.node}")
        return self.edges[b.node](out)

    def _loop(self, branches: list[_Branch]) -> Any:
        ready, running, result, finished = deque(branches), {}, None, False
        with ThreadPoolExecutor(self.workers if self.parallel else 1) as pool:
            while ready or running:
                self.current = [b.node for b in ready] + [b.node for b in running.values()]
                while ready and (self.parallel or not running):
                    b = ready.popleft()
                    running[pool.submit(self._do, b)] = b
                done: set[Future] = wait(running, return_when=FIRST_COMPLETED).done
                for f in sorted(done, key=lambda f: running[f].number):
                    b = running.pop(f)
                    try:
                        step = f.result()
                    except BaseException:
                        for other in running:
                            other.cancel()
                        raise
                    if isinstance(step, Finish):
                        result, finished = step.value, True
                    else:
                        self._apply(b, step, ready)
        self.current = [b.node for b in self.paused]
        return None if self.paused and not finished else result

    def _apply(self, b: _Branch, step: Any, ready: deque) -> None:
        if isinstance(step, Pause):
            self.paused.append(_Branch(b.number, step.node, step.value, b.group, b.place))
        elif isinstance(step, FanOut):
            if b.group is not None:
                raise TaskError("a fan-out inside a fan-out that isn't joined")
            if not step.branches:
                raise TaskError("a fan-out without branches")
            number = self._numbers
            self._groups[number] = _Group(step.join, len(step.branches))
            for place, (node, value) in enumerate(step.branches):
                ready.append(self._branch(node, value, number, place))
        elif isinstance(step, Next):
            group = self._groups.get(b.group) if b.group is not None else None
            if group is not None and step.node == group.join:
                group.got[b.place] = step.value
                if len(group.got) == group.size:
                    del self._groups[b.group]
                    ready.append(self._branch(step.node, [group.got[k] for k in sorted(group.got)]))
            else:
                ready.append(_Branch(b.number, step.node, step.value, b.group, b.place))
        else:
            raise TaskError(f"not a transition: {step!r}")


def prompt_node(model: Any) -> Callable[[str], str]:
    """A model as a node."""
    return lambda text: model.prompt(text)


def agent_node(agent: Any) -> Callable[[str], Any]:
    """An agent as a node: its input is the question, its output the reason it stopped for."""
    return lambda text: agent.query(text)


def fan_out(df: DataFrame, branches: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Every branch's rows with the branch's number; branches return ``task_id, payload``."""
    out = None
    for k, f in enumerate(branches):
        part = f(df).select("task_id", F.lit(k).alias("branch"), "payload")
        out = part if out is None else out.unionByName(part)
    return out


def join_branches(rows: DataFrame, branches: int) -> DataFrame:
    """Per task the payloads in the branches' order, once all branches have come: ``task_id, payloads``. A branch's repeated payloads count once, its different ones each."""
    got = rows.groupBy("task_id").agg(F.array_sort(F.collect_set(F.struct("branch", "payload"))).alias("b"))
    return got.where(F.size(F.array_distinct(F.transform("b", lambda x: x["branch"]))) >= branches).select("task_id", F.transform("b", lambda x: x["payload"]).alias("payloads"))
