"""Rewrites of rules that Spark's optimiser cannot make: the step's parity, and counts of which only the existence matters."""

from __future__ import annotations

from gridloom.functions.rules import Alternate, Compare, Const, Count, Exists, Node, map_tree


def at_step(rule: Node, t: int) -> Node:
    """The rule with alternatives resolved for step ``t``."""
    return map_tree(rule, lambda n: n.rules[t % len(n.rules)] if isinstance(n, Alternate) else n)


def _exists(n: Node) -> Node:
    if isinstance(n, Compare) and isinstance(n.left, Count) and isinstance(n.right, Const):
        if n.op == "gt" and n.right.value == 0:
            return Exists(n.left.value, n.left.hood)
        if n.op == "ne" and n.right.value == 0:
            return Exists(n.left.value, n.left.hood)
    return n


def optimised(rule: Node, t: int) -> Node:
    return map_tree(at_step(rule, t), _exists)


def period(rule: Node) -> int:
    """Steps after which the rule and the Margolus blocks repeat."""
    out = 1
    for n in rule.walk():
        k = len(n.rules) if isinstance(n, Alternate) else 2 if getattr(n, "hood", "") == "margolus" or type(n).__name__ == "Opposite" else 1
        while out % k:
            out += 1
    return out
