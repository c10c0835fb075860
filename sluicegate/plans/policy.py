"""Policies as data: immutable, validated, and written so that readers never see half of one."""

from __future__ import annotations

import json
import math
import os
import tempfile
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path


class InvalidPolicy(ValueError):
    """A policy that breaks its contract."""


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise InvalidPolicy(what)


@dataclass(frozen=True)
class LinearPolicy:
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    threshold: float
    version: int = 1
    calibrated_at: str = ""
    model: str = "logistic"
    metrics: dict = field(default_factory=dict)

    def validated(self) -> LinearPolicy:
        _need(isinstance(self.features, (list, tuple)) and isinstance(self.coefficients, (list, tuple)), "features and coefficients are lists")
        _need(len(self.features) > 0, "no features")
        _need(len(self.features) == len(self.coefficients), "features and coefficients differ in length")
        _need(all(isinstance(f, str) for f in self.features), "feature names are text")
        _need(all(_number(c) for c in self.coefficients), "coefficients are numbers")
        _need(_number(self.intercept), "the intercept is a number")
        _need(_number(self.threshold) and 0 <= self.threshold <= 1, "the threshold lies in [0, 1]")
        return replace(self, features=tuple(self.features), coefficients=tuple(self.coefficients))


@dataclass(frozen=True)
class TablePolicy:
    features: tuple[str, ...]
    cuts: dict[str, list[float]]
    table_shape: tuple[int, ...]
    table: tuple[float, ...]
    isotonic_x: tuple[float, ...]
    isotonic_y: tuple[float, ...]
    threshold: float
    category_prior: dict[str, float]
    version: int = 1
    calibrated_at: str = ""
    model: str = "boosted-table"
    metrics: dict = field(default_factory=dict)

    def validated(self) -> TablePolicy:
        _need(len(self.features) > 0, "no features")
        _need(set(self.cuts) == set(self.features), "cuts do not match the features")
        for name, cuts in self.cuts.items():
            _need(all(_number(c) for c in cuts) and all(a < b for a, b in zip(cuts, cuts[1:], strict=False)), f"cuts of {name} are not sorted and unique")
        _need(list(self.table_shape) == [len(self.cuts[f]) + 1 for f in self.features], "the table's shape does not match the cuts")
        _need(len(self.table) == math.prod(self.table_shape), "the table's size does not match its shape")
        _need(all(_number(v) for v in self.table), "table values are numbers")
        _need(len(self.isotonic_x) == len(self.isotonic_y) > 0, "isotonic points differ in number or are none")
        _need(all(a <= b for a, b in zip(self.isotonic_x, self.isotonic_x[1:], strict=False)), "isotonic x does not ascend")
        _need(_number(self.threshold) and 0 <= self.threshold <= 1, "the threshold lies in [0, 1]")
        _need(len(self.category_prior) > 0, "no category prior")
        return replace(self, features=tuple(self.features), table_shape=tuple(self.table_shape), table=tuple(self.table), isotonic_x=tuple(self.isotonic_x), isotonic_y=tuple(self.isotonic_y))


@dataclass(frozen=True)
class TreesPolicy:
    """The boosted trees themselves, where their lookup table would be too large.

    A tree is a leaf's value or [feature's number, cut, left, right]; x <= cut goes left, and NaN does too, as in the table.
    """

    features: tuple[str, ...]
    trees: tuple
    weights: tuple[float, ...]
    isotonic_x: tuple[float, ...]
    isotonic_y: tuple[float, ...]
    threshold: float
    category_prior: dict[str, float]
    version: int = 1
    calibrated_at: str = ""
    model: str = "boosted-trees"
    metrics: dict = field(default_factory=dict)

    def validated(self) -> TreesPolicy:
        _need(len(self.features) > 0, "no features")
        _need(len(self.trees) == len(self.weights) > 0, "trees and weights differ in number or are none")
        _need(all(_number(w) for w in self.weights), "weights are numbers")
        todo = list(self.trees)
        while todo:
            node = todo.pop()
            if not _number(node):
                _need(isinstance(node, (list, tuple)) and len(node) == 4 and node[0] in range(len(self.features)) and _number(node[1]), "a tree is broken")
                todo += node[2:]
        _need(len(self.isotonic_x) == len(self.isotonic_y) > 0, "isotonic points differ in number or are none")
        _need(all(a <= b for a, b in zip(self.isotonic_x, self.isotonic_x[1:], strict=False)), "isotonic x does not ascend")
        _need(_number(self.threshold) and 0 <= self.threshold <= 1, "the threshold lies in [0, 1]")
        _need(len(self.category_prior) > 0, "no category prior")
        return replace(self, features=tuple(self.features), trees=tuple(self.trees), weights=tuple(self.weights), isotonic_x=tuple(self.isotonic_x), isotonic_y=tuple(self.isotonic_y))


Policy = LinearPolicy | TablePolicy | TreesPolicy


def publish(policy: Policy, path: str | os.PathLike) -> Policy:
    """Validate, give the next version, write beside the target and swap in one step."""
    policy = policy.validated()
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    try:
        policy = replace(policy, version=max(policy.version, load(target).version + 1))
    except (FileNotFoundError, ValueError):
        pass
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=target.name, suffix=".tmp")
    try:
        with os.fdopen(handle, "w") as f:
            json.dump({"kind": type(policy).__name__, **asdict(policy)}, f)
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    return policy


def parse(text: str) -> Policy:
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise InvalidPolicy(f"not JSON: {e}") from e
    _need(isinstance(raw, dict), "not an object")
    kind = {"LinearPolicy": LinearPolicy, "TablePolicy": TablePolicy, "TreesPolicy": TreesPolicy}.get(raw.pop("kind", ""))
    _need(kind is not None, "unknown kind of policy")
    names = {f.name for f in fields(kind)}
    missing = names - raw.keys()
    _need(not missing, f"missing fields: {', '.join(sorted(missing))}")
    return kind(**{k: v for k, v in raw.items() if k in names}).validated()


def load(path: str | os.PathLike) -> Policy:
    """The published policy; FileNotFoundError if there is none, InvalidPolicy if it breaks its contract."""
    return parse(Path(path).read_text())


class PolicyHolder:
    """The policy in force: it must load at the start; a reload that fails keeps the one before."""

    def __init__(self, path: str | os.PathLike):
        self._path = path
        self.policy = load(path)
        self.stale = False

    def reload(self) -> bool:
        try:
            self.policy = load(self._path)
            self.stale = False
        except (OSError, ValueError):
            self.stale = True
        return not self.stale
