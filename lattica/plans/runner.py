"""Incremental execution of a task plan: what an invalidation knocked down runs again, the rest is served from what stands.

A plan's tasks are few (they name work, not data), so scheduling is driver logic; workers are driver functions that build DataFrames, and auditors are functions that judge
the result, best as queries that return violations. Every step is recorded in a hash-chained ledger.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from lattica.plans.ledger import GENESIS, digest


class PlanError(ValueError):
    pass


@dataclass
class Verdict:
    state: str  # ok, fail or disproved
    reason: str = ""
    evidence_id: str | None = None


@dataclass
class Task:
    name: str
    needs: tuple[str, ...] = ()
    ground: str | None = None
    worker: str = ""
    auditor: str | None = None
    state: str = "pending"
    attempt: int = 0
    output: dict | None = None


@dataclass
class Context:
    task: Task
    attempt: int
    inputs: dict[str, dict | None]


class Registry:
    """Workers and auditors by key; a key is never given twice, and nothing is imported from text."""

    def __init__(self) -> None:
        self.workers: dict[str, Callable[[Context], dict]] = {}
        self.auditors: dict[str, Callable[[Context, dict], Verdict | bool]] = {}

    def add(self, kind: str, key: str, fn: Callable) -> None:
        table = {"worker": self.workers, "auditor": self.auditors}[kind]
        if not key or any(c.isspace() or not c.isprintable() for c in key) or key in table:
            raise PlanError(f"{key!r} is no key, or is taken")
        table[key] = fn


@dataclass
class Round:
    layers: list[list[str]] = field(default_factory=list)
    executed: list[str] = field(default_factory=list)
    cached: list[str] = field(default_factory=list)
    blocked: dict[str, str] = field(default_factory=dict)
    failed: list[str] = field(default_factory=list)


class Runner:
    def __init__(self, tasks: list[Task], registry: Registry, grounds: dict[str, str] | None = None):
        self.tasks = {t.name: t for t in tasks}
        if len(self.tasks) != len(tasks):
            raise PlanError("task names repeat")
        self.registry, self.grounds = registry, dict(grounds or {})
        self.ledger: list[dict] = []
        self.rounds = 0
        for t in tasks:
            if unknown := set(t.needs) - set(self.tasks):
                raise PlanError(f"{t.name} needs {sorted(unknown)}, which nobody does")
        if len(sum(self.layers(), [])) < len(tasks):
            raise PlanError("the needs run in a circle")

    def layers(self) -> list[list[str]]:
        done: set[str] = set()
        out = []
        while layer := [t.name for t in self.tasks.values() if t.name not in done and set(t.needs) <= done]:
            out.append(layer)
            done |= set(layer)
        return out

    def record(self, event: str, task: str, detail: str = "") -> None:
        last = self.ledger[-1]["digest"] if self.ledger else GENESIS
        seq = len(self.ledger) + 1
        self.ledger.append({"chain": "run", "seq": seq, "event": event, "task": task, "detail": detail, "digest": digest(last, seq, None, event, task, detail, None, None, None)})

    def head(self) -> str:
        return self.ledger[-1]["digest"] if self.ledger else GENESIS

    def stands(self, t: Task) -> bool:
        return t.ground is None or self.grounds.get(t.ground, "active") == "active"

    def ready(self) -> list[Task]:
        return [t for t in self.tasks.values() if t.state in ("pending", "stale") and self.stands(t) and all(self.tasks[n].state == "done" for n in t.needs)]

    def run(self) -> Round:
        self.rounds += 1
        out = Round()
        standing = [t.name for t in self.tasks.values() if t.state == "done"]
        while layer := self.ready():
            out.layers.append([t.name for t in layer])
            for t in layer:
                if t.state in ("pending", "stale") and self.stands(t):
                    self._execute(t, out)
        for name in standing:
            if self.tasks[name].state == "done":
                out.cached.append(name)
                self.record("cached", name)
        for t in self.tasks.values():
            if t.state in ("pending", "stale"):
                why = "its ground fell" if not self.stands(t) else "needs " + ", ".join(n for n in t.needs if self.tasks[n].state != "done")
                out.blocked[t.name] = why
                self.record("blocked", t.name, why)
        return out

    def _judge(self, t: Task, output: dict) -> Verdict:
        if t.auditor is None:
            return Verdict("ok")
        verdict = self.registry.auditors[t.auditor](Context(t, t.attempt, {n: self.tasks[n].output for n in t.needs}), output)
        if isinstance(verdict, bool):
            return Verdict("ok" if verdict else "fail", "the auditor said no")
        if not isinstance(verdict, Verdict) or verdict.state not in ("ok", "fail", "disproved"):
            raise PlanError("an auditor returns a Verdict or a bool")
        return verdict

    def _execute(self, t: Task, out: Round) -> None:
        t.attempt += 1
        try:
            result = self.registry.workers[t.worker](Context(t, t.attempt, {n: self.tasks[n].output for n in t.needs}))
            verdict = self._judge(t, result)
        except PlanError:
            raise
        except Exception as e:  # a worker's failure is its task's
            t.state = "failed"
            out.failed.append(t.name)
            self.record("failed", t.name, str(e))
            return
        self.record("audited", t.name, verdict.state)
        if verdict.state == "ok":
            t.state, t.output = "done", result
            out.executed.append(t.name)
            self.record("executed", t.name)
        elif verdict.state == "disproved":
            self._disprove(t, verdict)
        else:
            t.state = "failed"
            out.failed.append(t.name)
            self.record("failed", t.name, verdict.reason)

    def _disprove(self, t: Task, verdict: Verdict) -> None:
        """The ground of a task falls, and with it every task that stands on it or needs one that does."""
        self.record("disproved", t.name, verdict.reason)
        if t.ground is None:
            t.state = "failed"
            return
        self.grounds[t.ground] = "rejected"
        fallen = {x.name for x in self.tasks.values() if x.ground == t.ground}
        while more := {x.name for x in self.tasks.values() if set(x.needs) & fallen} - fallen:
            fallen |= more
        for name in sorted(fallen):
            if self.tasks[name].state == "done" or name == t.name:
                self.tasks[name].state = "stale"
                self.record("invalidated", name, t.ground)

    def recheck(self, require_evidence: set[str] | None = None) -> list[str]:
        """Audit what stands, running nothing. With require_evidence, a disproof has to cite one of those ids."""
        disproved = []
        for t in list(self.tasks.values()):
            if t.state != "done" or t.auditor is None:
                continue
            try:
                verdict = self._judge(t, t.output or {})
            except PlanError:
                raise
            except Exception as e:
                t.state = "failed"
                self.record("failed", t.name, str(e))
                continue
            if verdict.state == "disproved" and (require_evidence is None or verdict.evidence_id in require_evidence):
                self._disprove(t, verdict)
                disproved.append(t.name)
        return disproved

    def repair(self, name: str, ground: str, worker: str | None = None) -> None:
        """A stale or failed task gets a new ground (and worker); everything is checked before anything changes."""
        t = self.tasks[name]
        if t.state not in ("stale", "failed"):
            raise PlanError(f"{name} is {t.state}")
        if self.grounds.get(ground, "active") != "active":
            raise PlanError(f"{ground!r} was rejected")
        if worker is not None and worker not in self.registry.workers:
            raise PlanError(f"no worker {worker!r}")
        t.ground, t.state = ground, "stale"
        t.worker = worker or t.worker
        self.grounds.setdefault(ground, "active")
        self.record("repaired", name, ground)
