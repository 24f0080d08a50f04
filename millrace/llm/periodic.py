"""Runs of repeated words, found online by catching squares over dyadic blocks.

Words are appended one at a time. Whenever ``2**k`` words that start at a multiple of ``2**k`` are
complete, they become a catcher: it waits for its words to occur again between ``2**(k+1) - 1`` and
``2**(k+2) - 2`` words later. A square of period p holds, in its first half, a whole block of the one size
whose range has p, so a catcher meets its block again before the square is complete.

* Every appended word advances the comparison of the suffixes of 1, 2, 4, .. words with the catchers: a
  suffix has a name if some block has the same words, and the name of a longer one is looked up from the
  names of its halves. It ends at the first size that no block matches, mostly at once.
* A catcher that is met gives a period p. The stretch of words that equal those p later is followed to its
  left; when ``2 * p`` words from there are complete, they are compared: equal halves are a new square.
* A new square opens a run. Each appended word either goes on with it or ends it. A catcher that is met
  inside an open run of a period that divides p says nothing new, so every run has its smallest period.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from millrace.llm.common import map_columns

#: A run has at least so many words, and two periods.
LEAST_WORDS = 12


class SquareCatcher:
    """Takes numbered words (from 1) in order and holds the runs among them.

    Work is O(log n) names a word, and each run or candidate costs its period; state is linear in the
    words and in the suffixes that match a block.
    """

    def __init__(self, least: int = LEAST_WORDS):
        self.least = least
        self.words = array("I")
        # Of each size 2**k: the name of the suffix that ends at a word (0: no block has these words), the
        # names by the names of both halves, and the starts of the blocks of each name.
        self.names: list[array] = [self.words]
        self.known: list[dict[int, int]] = [{}]
        self.blocks: list[list[list[int]]] = [[]]
        self.open: list[tuple[int, int]] = []
        self.due: dict[int, list[tuple[int, int]]] = {}
        self.met: dict[int, int] = {}
        self.ended: list[tuple[int, int, int]] = []

    def append(self, words: Iterable[int]) -> None:
        seen, names, known, blocks, due = self.words, self.names, self.known, self.blocks, self.due
        before = last = 0
        if seen:
            last = seen[-1]
            before = seen[-2] if len(seen) > 1 else 0
        for at, word in enumerate(words, len(seen)):
            seen.append(word)
            if self.open:
                self._go_on(at, word)
            if at in due:
                for start, period in due.pop(at):
                    middle = start + period
                    if seen[start:middle] == seen[middle : middle + period]:
                        self.open.append((start, period))
            if word == last:
                self._caught(1, at - 1, 1, at)
            if word == before:
                self._caught(1, at - 2, 2, at)
            # Suffixes of 2, 4, .. words; ``name`` is that of the second half.
            level, half, name, count = 1, 1, word, at + 1
            other = last
            while other:
                size = 2 * half
                key = other << 32 | name
                if level == len(known):
                    known.append({})
                    names.append(array("I"))
                    blocks.append([[]])
                complete = not count & (size - 1)
                found = known[level].get(key)
                if found is None:
                    if not complete:
                        break
                    found = known[level][key] = len(blocks[level])
                    blocks[level].append([count - size])
                else:
                    starts = blocks[level][found]
                    first = count - size
                    for s in reversed(starts):
                        period = first - s
                        if period >= 4 * size - 1:
                            break
                        if period >= 2 * size - 1:
                            self._caught(size, s, period, at)
                    if complete:
                        starts.append(first)
                mine = names[level]
                if len(mine) < at:
                    mine.frombytes(bytes(4 * (at - len(mine))))
                mine.append(found)
                # The half before the next, twice as long suffix.
                place = at - size
                if place + 1 < size:
                    break
                other = mine[place]
                level, half, name = level + 1, size, found
            before, last = last, word

    def _go_on(self, at: int, word: int) -> None:
        """The open runs that the appended word continues; the others end before it."""
        seen, going = self.words, []
        for run in self.open:
            if seen[at - run[1]] == word:
                going.append(run)
            else:
                self._end(run, at)
        self.open = going

    def _end(self, run: tuple[int, int], at: int) -> None:
        start, period = run
        if at - start >= max(self.least, 2 * period):
            self.ended.append((start, at - start, period))

    def _caught(self, size: int, block: int, period: int, at: int) -> None:
        """The words of ``block`` end again at ``at``, ``period`` words later."""
        for start, p in self.open:
            if start <= block and period % p == 0:
                return
        previous = self.met.get(period)
        self.met[period] = block
        if previous == block - size:
            # The block before was met at the same distance: this stretch is followed already.
            return
        start = self._begin(block, period)
        end = start + 2 * period - 1
        if end <= at:
            self.open.append((start, period))
        else:
            self.due.setdefault(end, []).append((start, period))

    def _begin(self, start: int, period: int) -> int:
        """How far to the left of ``start`` words equal those ``period`` later: steps double, then halve."""
        seen, step, growing = self.words, 1, True
        while step:
            other = start + period
            if step <= start and seen[start - step : start] == seen[other - step : other]:
                start -= step
                step = 2 * step if growing else step // 2
            else:
                growing, step = False, step // 2
        return start

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs of all words so far, by start, then period."""
        n = len(self.words)
        still = [(s, n - s, p) for s, p in self.open if n - s >= max(self.least, 2 * p)]
        return sorted(self.ended + still, key=lambda r: (r[0], r[2]))


def text_runs(words: list, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs among the words of one text."""
    numbers: dict = {}
    catcher = SquareCatcher(least)
    catcher.append([numbers.setdefault(w, len(numbers) + 1) for w in words])
    return catcher.runs()


def without_repeats(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words outside the runs' later periods: what a run holds after its first period goes."""
    kept, at = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in runs):
        if b > at:
            kept += words[at : max(at, a)]
            at = b
    return kept + words[at:]


def periodic_runs(
    docs: DataFrame, least: int = LEAST_WORDS, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its periodic runs, and its words without their repeats.

    ``runs`` is an array of (start, length, period), numbered in words from 0 and sorted by start, then
    period; ``collapsed`` joins the kept words by one space. ``rewrite`` may change the words of a row first.
    Null, empty and blank texts have no words, no runs and an empty ``collapsed``; repeated rows and null ids
    each give a row of their own; other columns are ignored; an empty table gives an empty result. A text is
    read by one task, which holds about 100 bytes a word of the longest text.
    """

    def step(_, ids, texts):
        out = {"doc_id": ids, "n_words": [], "runs": [], "collapsed": []}
        for doc, text in zip(ids, texts):
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            if rewrite is not None:
                words = rewrite(doc, words)
            runs = text_runs(words, least)
            out["n_words"].append(len(words))
            out["runs"].append([dict(zip(("start", "length", "period"), r)) for r in runs])
            out["collapsed"].append(b" ".join(without_repeats(words, runs)).decode("utf-8", "replace"))
        return out

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return map_columns(docs, ["doc_id", "text"], step, schema)
