"""Many literal replacements in one pass over a text."""

from __future__ import annotations

import ahocorasick


class Replacer:
    """Replacements (old, new), each over the whole text, one after another, as one pass where that is the same.

    An automaton finds all olds at once. Replacing them there and then is what the order would give unless occurrences touch,
    or a new text makes an old one that is still to come, by itself or with what stands around it. Which characters beside
    a new text could do that is known before; where one stands there, or an old is in a later one's way, the text is
    taken replacement by replacement.
    """

    def __init__(self, plan: list[tuple[str, str]]):
        self.plan = [(old, new) for old, new in plan if old]
        self.new_of: dict[str, str] = {}
        for old, new in self.plan:
            self.new_of.setdefault(old, new)  # a second one of an old finds nothing unless a new text made it
        self.ordered = any(not new for _, new in self.plan)
        self.after: set[str] = set()
        self.before: set[str] = set()
        self.automaton = ahocorasick.Automaton()
        for old in self.new_of:
            self.automaton.add_word(old, old)
        if self.plan:
            self.automaton.make_automaton()
        starts, ends = _going_on(self.new_of)
        inner = ahocorasick.Automaton()
        for new in {new for _, new in self.plan if new}:
            inner.add_word(new, new)
            if next(self.automaton.iter(new), None):
                self.ordered = True  # a new text holds an old one
            for k in range(1, len(new) + 1):
                self.after |= starts.get(new[-k:], set())
                self.before |= ends.get(new[:k], set())
        if len(inner):
            inner.make_automaton()
            for old in self.new_of:
                for end, new in inner.iter(old):
                    if end - len(new) >= 0:
                        self.before.add(old[end - len(new)])

    def __call__(self, text: str) -> str:
        if not self.plan:
            return text
        out, at, start_of_last = [], 0, -1
        for end, old in self.automaton.iter(text):
            start, end = end + 1 - len(old), end + 1
            if self.ordered or start < at or start == at and start_of_last >= 0:
                return self.one_by_one(text)
            if end < len(text) and text[end] in self.after or start > 0 and text[start - 1] in self.before:
                return self.one_by_one(text)
            out += [text[at:start], self.new_of[old]]
            at, start_of_last = end, start
        return "".join(out) + text[at:] if out else text

    def one_by_one(self, text: str) -> str:
        for old, new in self.plan:
            text = text.replace(old, new)
        return text


def _going_on(olds) -> tuple[dict[str, set[str]], dict[str, set[str]]]:
    """For each start of an old, short of the whole, the characters that follow it there; for each end those before it."""
    starts: dict[str, set[str]] = {}
    ends: dict[str, set[str]] = {}
    for old in olds:
        for k in range(1, len(old)):
            starts.setdefault(old[:k], set()).add(old[k])
            ends.setdefault(old[k:], set()).add(old[k - 1])
    return starts, ends
