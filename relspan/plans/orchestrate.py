"""Rounds of work until nothing is found: budgets, isolation, redistribution, and reports of what failed."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields


@dataclass
class Node:
    """work(state) gives the new state and the issues found; next_(state, issues) names the node that follows, None ends the loop."""

    work: Callable[[object], tuple[object, list[str]]]
    next_: Callable[[object, list[str]], str | None]
    on_error: str | None = None


@dataclass
class Outcome:
    state: object
    ended: str  # done, budget, failing
    rounds: int = 0
    issues: list[str] = field(default_factory=list)
    trend: float = 0.0  # of the number of issues, newer rounds weighing more
    errors: list[str] = field(default_factory=list)


def loop(nodes: dict[str, Node], start: str, state: object, budget: int, failures: int = 3, weight: float = 0.5) -> Outcome:
    """Runs from node to node. A round is one node's work; a node that fails goes on at on_error, and so many failures in a row end the loop."""
    out, at, row = Outcome(state, "done"), start, 0
    while at is not None:
        if out.rounds >= budget:
            out.ended = "budget"
            break
        out.rounds += 1
        node = nodes[at]
        try:
            out.state, out.issues = node.work(out.state)
            at = node.next_(out.state, out.issues)
        except Exception as e:  # whatever a node's work does wrong ends the round, not the loop
            out.errors.append(f"{at}: {type(e).__name__}: {e}")
            row += 1
            if row >= failures or node.on_error is None:
                out.ended = "failing"
                break
            at = node.on_error
            continue
        row = 0
        out.trend = len(out.issues) if out.rounds == 1 else weight * len(out.issues) + (1 - weight) * out.trend
    return out


def each(units: list, work: Callable[[object], object], workers: int = 8) -> list[tuple[object, str | None]]:
    """(result, None) or (None, error) of every unit, in order; a unit that fails takes no other with it."""

    def one(unit: object) -> tuple[object, str | None]:
        try:
            return work(unit), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(one, units))


class Budget:
    """Rounds by name. Whoever is done gives what is left to the others, evenly, the remainder to the first by name."""

    def __init__(self, names: list[str], rounds: int):
        self.left = dict.fromkeys(names, rounds)
        self.open = set(names)

    def take(self, name: str) -> bool:
        if self.left[name] <= 0:
            return False
        self.left[name] -= 1
        return True

    def done(self, name: str) -> None:
        self.open.discard(name)
        rest, self.left[name] = self.left[name], 0
        others = sorted(self.open)
        for i, o in enumerate(others):
            self.left[o] += rest // len(others) + (i < rest % len(others))


def again(required: set, covered: set, share: float = 1 / 3) -> bool:
    """Whether to part a text anew, once: a third or more of the required facts are uncovered."""
    return bool(required) and len(required - covered) >= share * len(required)


@dataclass(frozen=True)
class Switches:
    """What a run leaves out, to measure what it is worth."""

    enrichment: bool = True
    sharding: bool = True
    logical_constraints: bool = True
    chunking: bool = True
    budget: int = 3

    @classmethod
    def of(cls, given: dict) -> Switches:
        """From names and values; unknown names are an error."""
        known = {f.name for f in fields(cls)}
        if set(given) - known:
            raise ValueError(f"no switch {', '.join(sorted(set(given) - known))}")
        return cls(**given)


def lost(results: dict[str, tuple[object, str | None]], facts: dict[str, set[str]]) -> dict:
    """Which shards failed and why, the facts that only they had, and whether the rest is complete and feasible at all."""
    failed = {name: error for name, (_, error) in results.items() if error is not None}
    kept = set().union(*(facts.get(n, set()) for n in results if n not in failed))
    gone = set().union(*(facts.get(n, set()) for n in failed)) - kept
    return {"failed": failed, "lost_facts": sorted(gone), "complete": not gone, "feasible": len(failed) < len(results) or not results}
