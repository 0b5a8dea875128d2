"""Generalised suffix automaton over several token sequences."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """Accepts exactly the substrings of the sequences added so far.

    ``step`` is the transition table of each state, ``link`` its suffix link
    and ``length`` the length of its longest string.
    """

    def __init__(self) -> None:
        self.step: list[dict[Hashable, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, source: int, token: Hashable, target: int) -> int:
        """A copy of ``target`` for the strings that end one token after ``source``."""
        step, link, length = self.step, self.link, self.length
        copy = self._state(length[source] + 1, step[target].copy(), link[target])
        link[target] = copy
        while source >= 0 and step[source].get(token) == target:
            step[source][token] = copy
            source = link[source]
        return copy

    def add(self, tokens: Iterable[Hashable]) -> list[int]:
        """Adds a sequence; returns the state of each of its prefixes."""
        step, link, length = self.step, self.link, self.length
        last, prefixes = 0, []
        for token in tokens:
            known = step[last].get(token)
            if known is not None:  # the prefix is a substring already
                last = known if length[known] == length[last] + 1 else self._split(last, token, known)
            else:
                new, p = self._state(length[last] + 1, {}, 0), last
                while p >= 0 and token not in step[p]:
                    step[p][token] = new
                    p = link[p]
                if p >= 0:
                    target = step[p][token]
                    link[new] = target if length[target] == length[p] + 1 else self._split(p, token, target)
                last = new
            prefixes.append(last)
        return prefixes

    def match(self, tokens: Sequence[Hashable]) -> list[tuple[int, int]]:
        """Matching statistics: at each token the state and length of the longest
        suffix read so far that is a substring of an added sequence."""
        step, link, length = self.step, self.link, self.length
        state, size, out = 0, 0, []
        for token in tokens:
            target = step[state].get(token)
            while target is None and state:
                state = link[state]
                size = length[state]
                target = step[state].get(token)
            if target is not None:
                state, size = target, size + 1
            out.append((state, size))
        return out
