"""Leaves of one JSON text of any size and depth, event by event.

For the few documents that are beyond the limits of the engine's parser. No tree is built and
nothing recurses: the memory is the text and its leaves, and the stack is a list.
"""

from __future__ import annotations

import re
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_WORDS = {"true": ("bool", None, None, True), "false": ("bool", None, None, False), "null": ("null", None, None, None)}
_WORD = re.compile("|".join(_WORDS))

Leaf = tuple[str, str, float | None, str | None, bool | None]


def _text(s: str) -> str:
    """Halves of surrogate pairs that stand alone cannot be stored."""
    try:
        s.encode()
    except UnicodeEncodeError:
        return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return s


def walk(text: str, max_depth: int | None = None) -> list[Leaf]:
    """(path, kind, num, str, flag) of each leaf of a JSON object, in its order.

    As in ``profile.flatten_json``: a member adds ``.key`` to the path, an element ``[]``, empty
    containers give none, of equal keys the last counts, and containers below ``max_depth`` are
    ``truncated``, here with their text as found. Raises ValueError for anything else than one
    object, and for numbers that overflow a double.
    """
    leaves: list[Leaf | None] = []
    stack: list[list] = []  # is it an object, path, leaves of its members, first leaf and key of the current one
    hidden: tuple[int, int] | None = None  # depth and start of the container that is cut off
    path, at = "", _SPACE.match(text).end()
    if text[at : at + 1] != "{":
        raise ValueError("not an object")

    def skip(at: int) -> int:
        return _SPACE.match(text, at).end()

    def member(at: int) -> tuple[int, str]:
        """Past a member's key, and the path of its value."""
        if text[at : at + 1] != '"':
            raise ValueError(f"no key at {at}")
        key, at = scanstring(text, at + 1, True)
        at = skip(at)
        if text[at : at + 1] != ":":
            raise ValueError(f"no colon at {at}")
        frame = stack[-1]
        if key in frame[2]:
            for i in range(*frame[2][key]):
                leaves[i] = None
        frame[3], frame[4] = len(leaves), key
        return skip(at + 1), f"{frame[1]}.{_text(key)}"

    while True:
        c = text[at : at + 1]
        if c == "{" or c == "[":
            if hidden is None and max_depth is not None and len(stack) >= max_depth:
                hidden = (len(stack), at)
            stack.append([c == "{", path, {}, 0, None])
            at = skip(at + 1)
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                if c == "{":
                    at, path = member(at)
                else:
                    path += "[]"
                continue
        else:
            if c == '"':
                value, at = scanstring(text, at + 1, True)
                leaf = ("string", None, _text(value), None)
            elif word := _WORD.match(text, at):
                leaf, at = _WORDS[word[0]], word.end()
            elif number := _NUMBER.match(text, at):
                value, at = float(number[0]) + 0.0, number.end()
                if value in (float("inf"), float("-inf")):
                    raise ValueError(f"number beyond a double: {number[0][:40]}")
                leaf = ("number", value, None, None)
            else:
                raise ValueError(f"no value at {at}")
            if hidden is None:
                leaves.append((path, *leaf))
            at = _next(text, stack, leaves, skip(at))
        # a value is complete: close what ends here, or go on with the next one
        while stack:
            frame = stack[-1]
            c = text[at : at + 1]
            if c == ",":
                at = skip(at + 1)
                if frame[0]:
                    at, path = member(at)
                else:
                    path = frame[1] + "[]"
                break
            if c != ("}" if frame[0] else "]"):
                raise ValueError(f"no end at {at}")
            stack.pop()
            at += 1
            path = frame[1]
            if hidden is not None and len(stack) == hidden[0]:
                leaves.append((path, "truncated", None, text[hidden[1] : at], None))
                hidden = None
            at = _next(text, stack, leaves, skip(at))
        else:
            if at != len(text):
                raise ValueError(f"more than one value, at {at}")
            return [leaf for leaf in leaves if leaf is not None]


def _next(text: str, stack: list, leaves: list, at: int) -> int:
    """Notes the leaves of the member that has just been read."""
    if stack and stack[-1][0] and stack[-1][4] is not None:
        stack[-1][2][stack[-1][4]] = (stack[-1][3], len(leaves))
    return at
