"""Replacement and removal of phrases: all rules in one pass over the text's tokens.

The rules' tokens make an Aho-Corasick automaton (CACM 18:6, 1975): a trie in which every state knows the longest proper
suffix that is a state too. One walk over a text's tokens finds the ends of all phrases, however many rules there are. Of the
phrases that overlap, the one that begins first stands, and of those the longest; of equal phrases the first rule.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, functions as F

#: As ``functions.text.WORD_PATTERN``: runs of letters and digits, and every other visible character by itself.
_TOKENS = regex.compile(r"[\p{L}\p{N}]+|[^\s\x0B\x1c-\x1f\x85\p{Z}\p{L}\p{N}]")


class PhraseAutomaton:
    """The phrases of a list of rules; a phrase without a token is never found."""

    def __init__(self, phrases: Sequence[str | None]):
        self.steps: list[dict[str, int]] = [{}]
        self.length: list[int] = [0]
        self.rule: list[int] = [-1]
        for number, phrase in enumerate(phrases):
            state = 0
            for token in _TOKENS.findall((phrase or "").lower()):
                if token not in self.steps[state]:
                    self.steps[state][token] = len(self.steps)
                    self.steps.append({})
                    self.length.append(self.length[state] + 1)
                    self.rule.append(-1)
                state = self.steps[state][token]
            if state and self.rule[state] < 0:
                self.rule[state] = number
        # The longest proper suffix of each state, and the longest one that ends a phrase; shorter states come first.
        self.suffix, self.ending = [0] * len(self.steps), [0] * len(self.steps)
        waiting = deque(self.steps[0].values())
        while waiting:
            state = waiting.popleft()
            for token, after in self.steps[state].items():
                back = self.suffix[state]
                while back and token not in self.steps[back]:
                    back = self.suffix[back]
                self.suffix[after] = self.steps[back].get(token, 0)
                waiting.append(after)
            back = self.suffix[state]
            self.ending[state] = back if self.rule[back] >= 0 else self.ending[back]

    def find(self, tokens: Sequence[str]) -> list[tuple[int, int, int]]:
        """(first token, token behind the last, rule) of the phrases that stand, in order."""
        longest: dict[int, tuple[int, int]] = {}
        state = 0
        for place, token in enumerate(tokens):
            while state and token not in self.steps[state]:
                state = self.suffix[state]
            state = self.steps[state].get(token, 0)
            found = state if self.rule[state] >= 0 else self.ending[state]
            while found:
                # Later ends at the same beginning are longer, so they take the place of earlier ones.
                longest[place + 1 - self.length[found]] = (place + 1, self.rule[found])
                found = self.ending[found]
        standing, free = [], 0
        for start in sorted(longest):
            if start >= free:
                free, rule = longest[start]
                standing.append((start, free, rule))
        return standing

    def edit(self, text: str, replacements: Sequence[str | None]) -> str:
        """The text with each phrase replaced; a missing replacement leaves its phrase as it is."""
        spans = [(m.group().lower(), m.start(), m.end()) for m in _TOKENS.finditer(text)]
        parts, at = [], 0
        for start, end, rule in self.find([s[0] for s in spans]):
            new = replacements[rule] if rule < len(replacements) else None
            if new is not None:
                parts += [text[at : spans[start][1]], new]
                at = spans[end - 1][2]
        return "".join([*parts, text[at:]])


def replace_phrases(text: Column, phrases: Column, replacements: Column) -> Column:
    """Every phrase of the array ``phrases``, in whatever case and spacing, becomes its partner; all else stays as it is.

    The rules may differ from row to row; equal rules that follow each other share one automaton. A null text gives null, and
    null arrays are no rules.
    """

    @F.arrow_udf("string")
    def replace(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, automaton = None, None
        for columns in batches:
            out = []
            for t, given, new in zip(*(c.to_pylist() for c in columns)):
                if given != last or automaton is None:
                    last, automaton = given, PhraseAutomaton(given or [])
                out.append(None if t is None else automaton.edit(t, new or []))
            yield pa.array(out, pa.string())

    return replace(text, phrases, replacements)


def remove_phrases(text: Column, phrases: Column) -> Column:
    """Every phrase goes; the white space around it stays, as with single words."""
    return replace_phrases(text, phrases, F.transform(phrases, lambda p: F.lit("")))
