"""A generalised suffix automaton over any hashable symbols, and matching statistics against it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence


class SuffixAutomaton:
    """Recognises every substring of the sequences added so far; linear in their total length."""

    def __init__(self, sequences: Iterable[Sequence] = ()):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        for sequence in sequences:
            self.add(sequence)

    def _state(self, length: int, edges: dict) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(0)
        return len(self.length) - 1

    def _split(self, state: int, target: int, symbol) -> int:
        """The state for the strings of state followed by symbol, cut off from target if it has longer ones."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._state(self.length[state] + 1, dict(self.next[target]))
        self.link[clone] = self.link[target]
        self.link[target] = clone
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = clone
            state = self.link[state]
        return clone

    def add(self, sequence: Sequence) -> None:
        last = 0
        for symbol in sequence:
            if symbol in self.next[last]:
                last = self._split(last, self.next[last][symbol], symbol)
                continue
            new, state = self._state(self.length[last] + 1, {}), last
            while state >= 0 and symbol not in self.next[state]:
                self.next[state][symbol] = new
                state = self.link[state]
            if state >= 0:
                self.link[new] = self._split(state, self.next[state][symbol], symbol)
            last = new

    def matching(self, sequence: Iterable) -> Iterator[int]:
        """For each position, the length of the longest substring ending there that the automaton knows."""
        state, known = 0, 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                known = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                known += 1
            yield known
