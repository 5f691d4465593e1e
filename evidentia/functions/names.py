"""All names of parameters in one automaton: a page is read once, however many names there are.

The automaton works on a folded text of the same length (case, and every kind of separator as a space), which finds each place where a name
may stand; the exact pattern of that name then decides at that place alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import ahocorasick

from ..dims import PARAMS

#: Letters beyond ASCII that match an ASCII letter when case is ignored.
_LIKE = {0x17F: "s", 0x130: "i", 0x131: "i", 0x212A: "k"}
_SEPARATORS = {c: " " for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, ord("_"), ord("-"))}
_FOLD = _LIKE | _SEPARATORS
_WORD = re.compile(r"(?i)[A-Za-z0-9_]")


def fold(text: str) -> str:
    text = text.translate(_FOLD)
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def spaced(alias: str) -> str:
    """A pattern of a name, in which a space may be any separator."""
    return re.escape(alias).replace(r"\ ", r"[\s_\-]")


def bounded(alias: str) -> str:
    """A pattern of a name as it is written, an ASCII one as a word of its own."""
    return rf"(?<![A-Za-z0-9_]){re.escape(alias)}(?![A-Za-z0-9_])" if alias.isascii() else re.escape(alias)


class NameIndex:
    """The names of a table of parameters; a name is known by its place ``i`` in ``entries``."""

    def __init__(self, params: Mapping[str, tuple[str, Sequence[str]]] = PARAMS) -> None:
        self.entries = [(key, alias) for key, (_, names) in params.items() for alias in names]
        by_form: dict[str, list[int]] = {}
        for i, (_, alias) in enumerate(self.entries):
            by_form.setdefault(fold(alias), []).append(i)
        self._automaton = ahocorasick.Automaton()
        for form, places in by_form.items():
            self._automaton.add_word(form, (len(form), places))
        self._automaton.make_automaton()
        self._compiled: dict[tuple[int, str], re.Pattern[str]] = {}

    def pattern(self, i: int, kind: str, make: Callable[[str], str]) -> re.Pattern[str]:
        """The pattern of a kind of one name, compiled when a page first asks for it."""
        if (i, kind) not in self._compiled:
            self._compiled[i, kind] = re.compile(make(self.entries[i][1]))
        return self._compiled[i, kind]

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, i) of every place where a name may stand, overlapping ones too."""
        if self.entries:
            for last, (size, places) in self._automaton.iter(fold(text)):
                for i in places:
                    yield last + 1 - size, last + 1, i

    def places(self, text: str) -> dict[int, list[int]]:
        """The starts of each name that a text may hold, names and starts in order."""
        found: dict[int, list[int]] = {}
        for start, _, i in self.hits(text):
            found.setdefault(i, []).append(start)
        return {i: sorted(found[i]) for i in sorted(found)}


def is_word(char: str) -> bool:
    return _WORD.match(char) is not None
