"""A generalised suffix automaton over word sequences.

One automaton holds every sequence of a block. Its states are the classes of word strings that end
at the same places; a text is streamed through it word by word, and the length matched so far is
always the longest suffix of the text read that occurs in some sequence.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """``least`` words make a window; a shorter sequence is one window as a whole."""

    def __init__(self, sequences: Iterable[tuple[object, Sequence[bytes]]], least: int):
        self.least, self.next, self.link, self.length = least, [{}], [-1], [0]
        ends: list[tuple[int, object, int]] = []  # state after a prefix, its sequence, the prefix's length
        shorts: list[tuple[int, object, int]] = []
        for key, words in sequences:
            state = 0
            for n, word in enumerate(words, 1):
                state = self._extend(state, word)
                ends.append((state, key, n))
            if 0 < len(words) < least:
                shorts.append((state, key, len(words)))
        self._window_owners(ends)
        self._short_owners(shorts)

    def _extend(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (old := nxt[last].get(word)) is not None:
            return old if length[old] == length[last] + 1 else self._split(last, word, old)
        state = self._state({}, length[last] + 1)
        p = last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = state
            p = link[p]
        if p == -1:
            link[state] = 0
        else:
            old = nxt[p][word]
            link[state] = old if length[old] == length[p] + 1 else self._split(p, word, old)
        return state

    def _state(self, arcs: dict, length: int) -> int:
        self.next.append(arcs)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, old: int) -> int:
        """The strings of ``old`` that are no longer than p's plus this word become a state."""
        twin = self._state(dict(self.next[old]), self.length[p] + 1)
        self.link[twin] = self.link[old]
        self.link[old] = twin
        while p != -1 and self.next[p].get(word) == old:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def _at(self, state: int, n: int) -> int:
        """The state of the last n words of a string that ``state`` stands for."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _window_owners(self, ends: list) -> None:
        owners: dict[int, set] = {}
        for state, key, n in ends:
            if n >= self.least:
                owners.setdefault(self._at(state, self.least), set()).add(key)
        self.owners = owners
        # where a longer match leads; states too short for a window lead nowhere
        self.window = [self._at(s, self.least) if n >= self.least else -1 for s, n in enumerate(self.length)]

    def _short_owners(self, shorts: list) -> None:
        """For each state the short sequences that are a suffix of its strings, longest first."""
        own: dict[int, list] = {}
        for state, key, n in shorts:
            own.setdefault(self._at(state, n), []).append((n, key))
        self.short: list[tuple] = [()] * len(self.length)
        if own:
            for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
                above = self.short[self.link[s]]
                self.short[s] = (*sorted(own[s], key=lambda x: -x[0]), *above) if s in own else above

    def stream(self, words: Sequence[bytes], known: Iterable[int] | None = None) -> tuple[list[tuple[int, int]], set]:
        """Spans of words that lie inside a window (start, end; merged, in order) and the keys
        of the sequences whose windows occur."""
        nxt, link, length, window, short, least = self.next, self.link, self.length, self.window, self.short, self.least
        spans: list[list[int]] = []
        keys: set = set()
        seen: set = set()
        state = matched = 0

        def hit(start: int, end: int) -> None:
            while spans and spans[-1][0] >= start:  # a window that starts before an earlier, shorter one
                spans.pop()
            if spans and spans[-1][1] >= start:
                spans[-1][1] = max(spans[-1][1], end)
            else:
                spans.append([start, end])

        for i, word in enumerate(words, 1):
            to = nxt[state].get(word)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = nxt[state].get(word)
                matched = length[state]
                if to is None:
                    state = matched = 0
                    continue
            state = to
            matched += 1
            if matched >= least:
                hit(i - least, i)
                if (w := window[state]) not in seen:
                    seen.add(w)
                    keys |= self.owners[w]
            for n, key in short[state]:
                if n <= matched:
                    hit(i - n, i)
                    keys.add(key)
        return [(a, b) for a, b in spans], keys
