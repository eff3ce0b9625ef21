"""Configuration files of sources and sinks: YAML, flattened to dotted names, with `extends`."""

from __future__ import annotations

import os


def _scalar(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def parse(text: str) -> dict[str, str]:
    """Nested mappings of scalars as dotted names; lists as texts joined by commas. This is the part of YAML that such files use."""
    found: dict[str, str] = {}
    path: list[tuple[int, str]] = []
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith(("#", "---")):
            continue
        depth = len(bare) - len(bare.lstrip())
        body = bare.strip()
        if body.startswith("- "):
            while path and path[-1][0] > depth:
                path.pop()
            name = ".".join(p for _, p in path)
            found[name] = ",".join(filter(None, [found.get(name, ""), _scalar(body[2:])]))
            continue
        key, colon, value = body.partition(":")
        if not colon:
            raise ValueError(f"not a pair: {body}")
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, _scalar(key)))
        if value.strip():
            found[".".join(p for _, p in path)] = _scalar(value)
    return found


def load(path: str, seen: tuple[str, ...] = ()) -> dict[str, str]:
    """Options of a file. What it sets itself wins over the file that it extends, which is looked for beside it."""
    path = os.path.abspath(path)
    if path in seen:
        raise ValueError(f"{path} extends itself")
    with open(path) as f:
        own = parse(f.read())
    base = own.pop("extends", None)
    return (load(os.path.join(os.path.dirname(path), base), (*seen, path)) if base else {}) | own
