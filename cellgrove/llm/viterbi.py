"""Token counts of a unigram tokenizer by a Viterbi pass that carries counts only.

An Aho-Corasick automaton gives every vocabulary entry that ends at a position;
the best score of a position is the best sum of an entry's score and that of its
start. Nothing is remembered to trace a path back: the number of pieces is carried
along. Ties go to the entry that starts first, i.e. the longest; a letter that is
no entry costs ten less than the lowest score, loses all ties, and counts as one
piece or as its bytes if the vocabulary has them.

The registered query reads a BPE file (``piece_bpe_32k.model``) as a stand-in: its
scores are minus merge ranks, not log frequencies, so its counts are those of no
published tokenizer. See the README.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from cellgrove.llm.common import map_texts

#: Stands for a space.
SPACE = "▁"
#: A run of spaces and what follows it; entries made of spaces alone lie inside one.
_WORD, _BORDER = re.compile(f"{SPACE}+[^{SPACE}]*"), re.compile(f"[^{SPACE}]{SPACE}")
UNKNOWN_PENALTY = 10.0
NEVER = float("-inf")
CACHED_WORDS, BLOCK_CHARS = 500_000, 1 << 20


@dataclass(frozen=True)
class Unigram:
    """Entries and scores; ``unknown`` is the index of the unknown entry."""

    entries: tuple[tuple[str, float], ...]
    unknown: int = 0
    byte_fallback: bool = True

    @staticmethod
    def read(path: str) -> "Unigram":
        """Entries and scores of a sentencepiece file, in its order."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        entries = tuple((sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()))
        return Unigram(entries, sp.unk_id())


class Counter:
    """Counts pieces of texts; remembers a bounded number of words."""

    def __init__(self, model: Unigram):
        self.automaton = ahocorasick.Automaton()
        scores: dict[str, float] = dict(model.entries)
        unknown = model.entries[model.unknown][0]
        for entry, score in scores.items():
            if entry:
                self.automaton.add_word(entry, (len(entry), score, entry == unknown))
        self.automaton.make_automaton()
        self.single = {e for e in scores if len(e) == 1}
        self.low = min(scores.values()) - UNKNOWN_PENALTY
        self.bytes = model.byte_fallback and all(f"<0x{b:02X}>" in scores for b in range(256))
        self.known: dict[str, tuple[int, float]] = {}
        # entries with a mark behind a letter leave no place to cut at
        self.cut = not any(re.search(f"[^{SPACE}]{SPACE}", e) for e in scores)

    def best(self, word: str) -> tuple[int, float]:
        """Number of pieces and score of one word.

        The automaton gives matches in order of their ends and, for one end, the
        longest first; so of equal sums the one that starts first is met first.
        """
        if not self.single.issuperset(word):
            return self._with_unknown(word)
        score, count = [0.0] + [NEVER] * len(word), [0] * (len(word) + 1)
        for end, (size, gain, _) in self.automaton.iter(word):
            end += 1
            total = score[end - size] + gain
            if total > score[end]:
                score[end] = total
                count[end] = count[end - size] + 1
        return count[-1], score[-1]

    def _with_unknown(self, word: str) -> tuple[int, float]:
        """The same where some letter is no entry.

        Adjacent unknown letters, and the unknown entry written out, are one run:
        one piece, or its bytes unless the run is just that entry written out.
        """
        n = len(word)
        score, count = [0.0] + [NEVER] * n, [0] * (n + 1)
        runs: dict[int, tuple[int, int, int, bool]] = {}  # by end: pieces before it, bytes, parts, written out

        def run_at(start: int, size: int, written: bool) -> tuple[int, tuple[int, int, int, bool]]:
            before, length, parts, _ = runs.get(start, (count[start], 0, 0, False))
            length += len(word[start : start + size].encode())
            pieces = 1 if not self.bytes or (parts == 0 and written) else length
            return before + pieces, (before, length, parts + 1, written)

        found: dict[int, list[tuple[int, float, bool]]] = {}
        for end, match in self.automaton.iter(word):
            found.setdefault(end + 1, []).append(match)
        for end in range(1, n + 1):
            for size, gain, unknown in found.get(end, ()):
                total = score[end - size] + gain
                if total > score[end]:
                    score[end] = total
                    runs.pop(end, None)
                    if unknown:
                        count[end], runs[end] = run_at(end - size, size, True)
                    else:
                        count[end] = count[end - size] + 1
            if word[end - 1] not in self.single and score[end - 1] + self.low > score[end]:
                score[end] = score[end - 1] + self.low
                count[end], runs[end] = run_at(end - 1, 1, False)
        return count[n], score[n]

    def count(self, text: str | None) -> tuple[int, float]:
        """Pieces and score of a whole text; an empty one has none."""
        total, gain = 0, 0.0
        marked = (text or "").replace(" ", SPACE)
        marked = marked if marked[:1] in ("", SPACE) else SPACE + marked
        if not self.cut:
            return self.best(marked)
        for block in _blocks(marked):
            words = _WORD.findall(block)
            known = self.known
            if len(known) > CACHED_WORDS:
                known.clear()
            for w in {w for w in words if w not in known}:
                known[w] = self.best(w)
            found = [known[w] for w in words]
            total += sum([f[0] for f in found])
            gain += sum([f[1] for f in found])
        return total, gain


def _blocks(marked: str) -> Iterator[str]:
    """The marked text in blocks that begin with a whole run of marks."""
    at = 0
    while at < len(marked):
        found = _BORDER.search(marked, at + BLOCK_CHARS)
        cut = found.start() + 1 if found else len(marked)
        yield marked[at:cut]
        at = cut


_COUNTERS: dict[int, Counter] = {}


def token_counts(docs: DataFrame, model: Unigram, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens`` and ``score`` (of the best path) per row; null texts count as empty ones.

    Scores are summed in double precision over runs of spaces with the word after
    them, which no entry crosses; a vocabulary with an entry that does is matched over
    whole texts.
    The vocabulary has a fixed size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = hash(model)

    def make():
        counter = _COUNTERS.get(name)
        if counter is None:
            counter = _COUNTERS[name] = Counter(shared.value)

        def work(texts):
            found = [counter.count(t) for t in texts]
            return [np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], float)]

        return work

    return map_texts(docs, key, text, make, "n_tokens long, score double")
