"""The logical topology of a pipeline, for display; Catalyst has the real plan."""

from __future__ import annotations

from dataclasses import dataclass

#: Node kinds and their shapes in the drawing.
SHAPES = {"source": "ellipse", "table": "cylinder", "sink": "house", "branch": "diamond", "predicate": "ellipse", "joiner": "hexagon", "stream_joiner": "hexagon", "materializer": "cylinder", "store": "cylinder", "through": "rarrow"}


@dataclass(frozen=True)
class Node:
    kind: str
    name: str
    inputs: tuple[Node, ...] = ()


def to_dot(*ends: Node) -> str:
    """The graph that leads to these nodes, in the DOT language; nodes that several ends share are drawn once."""
    names: dict[int, str] = {}
    lines: list[str] = []

    def visit(n: Node) -> str:
        if id(n) in names:
            return names[id(n)]
        inputs = [visit(i) for i in n.inputs]
        me = names[id(n)] = f"n{len(names)}"
        label = f"{n.kind}: {n.name}".replace("\\", "\\\\").replace('"', '\\"')
        lines.append(f'  {me} [label="{label}", shape={SHAPES.get(n.kind, "box")}];')
        lines.extend(f"  {i} -> {me};" for i in inputs)
        return me

    for e in ends:
        visit(e)
    return "\n".join(["digraph topology {", "  rankdir=LR;", *lines, "}"])
