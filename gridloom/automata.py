"""The ten automata that come with the engine, as rules, states, initial distributions and glyphs."""

from __future__ import annotations

from dataclasses import dataclass, field

from gridloom.functions.rules import DOWN, HERE, LEFT, MARGOLUS, MOORE, RIGHT, UP, VON_NEUMANN, Alternate, Node, Opposite, State, count, when
from gridloom.operators.grid import States


@dataclass(frozen=True)
class Automaton:
    """``start`` are (ordinal, probability) pairs of the random initial grid, in the order in which thresholds are cumulated; none for wire."""

    name: str
    rule: Node
    states: States
    start: tuple[tuple[int, float], ...] = ()
    aliases: tuple[str, ...] = field(default=())


def _life() -> Node:
    n = count(State(1), MOORE)
    return when(HERE == State(1)).then(when((n == 2) | (n == 3)).then(State(1)).otherwise(State(0))).when(n == 3).then(State(1)).otherwise(State(0))


def _maze() -> Node:
    n = count(State(1), MOORE)
    return when(n == 3).then(State(1)).when((HERE == State(1)) & (n < 6)).then(State(1)).otherwise(State(0))


def _brian() -> Node:
    born = when(count(State(2), MOORE) == 2).then(State(2)).otherwise(State(0))
    return when(HERE == State(0)).then(born).when(HERE == State(2)).then(State(1)).otherwise(State(0))


def _fire() -> Node:
    empty, tree, ash, fire = State(0), State(1), State(2), State(3)
    burning = count(fire, VON_NEUMANN) > 0
    return (
        when(HERE == fire).then(ash)
        .when(HERE == ash).then(when(burning).then(ash).otherwise(empty))
        .when(HERE == tree).then(when(burning).then(fire).otherwise(tree))
        .otherwise(empty)
    )


def _wire() -> Node:
    empty, head, tail, conductor = State(0), State(1), State(2), State(3)
    n = count(head, MOORE)
    return when(HERE == head).then(tail).when(HERE == tail).then(conductor).when(HERE == conductor).then(when((n == 1) | (n == 2)).then(head).otherwise(conductor)).otherwise(empty)


def _excitable() -> Node:
    chain = when(HERE == State(0)).then(when(count(State(1), MOORE) > 0).then(State(1)).otherwise(State(0)))
    for k in range(1, 7):
        chain = chain.when(HERE == State(k)).then(State(k + 1))
    return chain.otherwise(State(0))


def _cyclic() -> Node:
    following = (HERE + 1) % 32
    return when(count(following, MOORE) > 0).then(following).otherwise(HERE)


def _fluid() -> Node:
    """Particles move up, down, left or right by one cell; two that meet head on leave at right angles."""
    up, down, left, right = UP.bit_and(1), DOWN.bit_and(2), LEFT.bit_and(4), RIGHT.bit_and(8)
    vertical, horizontal = up.bit_or(down), left.bit_or(right)
    first = when((up > 0) & (down > 0) & (horizontal == 0)).then(12).otherwise(vertical)
    second = when((left > 0) & (right > 0) & (vertical == 0)).then(3).otherwise(horizontal)
    return first.bit_or(second)


def _critters() -> Node:
    n = count(State(1), MARGOLUS)
    flip = lambda cell: when(cell == State(1)).then(State(0)).otherwise(State(1))
    return when(n == 3).then(flip(Opposite())).when(n == 2).then(HERE).otherwise(flip(HERE))


def _traffic() -> Node:
    empty = State(0)

    def moving(car: State, still: State, behind: Node, ahead: Node) -> Node:
        return when(HERE == car).then(when(ahead == empty).then(empty).otherwise(car)).when(HERE == empty).then(when(behind == car).then(car).otherwise(empty)).otherwise(still)

    return Alternate((moving(State(1), State(2), LEFT, RIGHT), moving(State(2), State(1), UP, DOWN)))


_EVEN = lambda n: tuple((i, 1 / n) for i in range(n))
_SHADES = {i: chr(ord("A") + i) if i < 26 else chr(ord("a") + i - 26) for i in range(32)}
_GAS = {i: "0123456789abcdef"[i] if i else "." for i in range(16)}

AUTOMATA: dict[str, Automaton] = {
    a.name: a
    for a in (
        Automaton("game-of-life", _life(), States((0, 1), ("dead", "alive"), {0: ".", 1: "#"}), ((1, 0.2), (0, 0.8))),
        Automaton("maze", _maze(), States((0, 1), ("empty", "wall"), {0: ".", 1: "#"}), ((0, 0.8), (1, 0.2))),
        Automaton("brian", _brian(), States((0, 1, 2), ("dead", "dying", "alive"), {0: ".", 1: "*", 2: "#"}), ((2, 0.2), (0, 0.8))),
        Automaton("forest-fire", _fire(), States((0, 1, 3, 2), ("empty", "tree", "fire", "ash"), {0: ".", 1: "#", 2: "*", 3: "@"}), ((0, 0.20), (1, 0.79), (3, 0.01), (2, 0.0)), ("fire",)),
        Automaton("wire", _wire(), States((0, 1, 2, 3), ("empty", "electron head", "electron tail", "conductor"), {0: ".", 1: "@", 2: "#", 3: "-"})),
        Automaton("excitable", _excitable(), States(tuple(range(8)), ("quiescent", "excited", *(f"refractory {i}" for i in range(1, 7))), {0: "·"} | dict.fromkeys(range(1, 8), "█")), tuple(enumerate((0.70, 0.15, 0.05, 0.03, 0.03, 0.02, 0.01, 0.01)))),
        Automaton("cyclic", _cyclic(), States(tuple(range(32)), (), _SHADES), _EVEN(32)),
        Automaton("fluid", _fluid(), States(tuple(range(16)), (), _GAS), _EVEN(16)),
        Automaton("critters", _critters(), States((0, 1), ("dead", "alive"), {0: ".", 1: "O"}), ((0, 0.5), (1, 0.5))),
        Automaton("traffic", _traffic(), States((0, 1, 2), ("empty", "red car", "blue car"), {0: ".", 1: ">", 2: "v"}), ((0, 0.5), (1, 0.25), (2, 0.25))),
    )
}


def automaton(name: str) -> Automaton:
    """By name or alias; unknown names are an error."""
    for a in AUTOMATA.values():
        if name == a.name or name in a.aliases:
            return a
    raise KeyError(f"unknown automaton {name}; there are {', '.join(AUTOMATA)}")
