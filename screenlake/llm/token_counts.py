"""Word-piece counts by a linear longest-match automaton.

A trie of the vocabulary gets failure links, and each node the number of tokens
that are popped when its link is followed. A word is read once, character by
character, and only numbers are added; no piece is ever built. The count equals
that of greedy longest match from the left. All words of some texts are read
side by side, by a table of the states for the characters that most pieces have;
words with others and very long ones are read one by one.

A word is what stands between characters of [\\x20\\x09-\\x0D], with the mark
for a word's start before it. A character that no piece begins with costs as
many tokens as it has UTF-8 bytes. Null and empty texts have no words. Long
words and long texts count whole, repeated rows alike; a null doc_id is kept as
it is. Other columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from screenlake.llm.common import id_text, map_batches, texts_of

#: Words read one by one whose counts a worker keeps.
CACHED = 50_000
MARK = "▁"
#: Characters that have a column in the table of states (ASCII first), 0 for all others; and what white space has instead.
CLASSES = 192
BLANK = 255
#: Characters of texts whose words are read side by side, and of the longest such word.
GROUP = 500_000
LONG = 64


class Automaton:
    def __init__(self, pieces: list[str], mark: str = MARK):
        self.mark = mark
        self.next: list[dict[str, int]] = [{}]
        cost = [0]
        known = {x: 1 for x in pieces if x}
        for c in sorted({c for x in known for c in x}):
            known.setdefault(c, len(c.encode()))
        for piece, price in known.items():
            at = 0
            for c in piece:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    cost.append(0)
                at = self.next[at][c]
            cost[at] = price
        # breadth first: the link of a node is the state after popping the longest pieces of its string
        self.link, self.pop = [-1] * len(cost), [0] * len(cost)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for c, node in self.next[parent].items():
                queue.append(node)
                if cost[node]:
                    self.link[node], self.pop[node] = 0, cost[node]
                    continue
                at, popped = self.link[parent], self.pop[parent]
                while c not in self.next[at]:
                    popped += self.pop[at]
                    at = self.link[at]
                self.link[node], self.pop[node] = self.next[at][c], popped

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Classes of characters; by node and class the next node and, in the low 8 bits, the tokens on the way; and by node those at a word's end.

        None if these numbers don't fit.
        """
        ends = [0] * len(self.next)
        most = Counter(c for children in self.next for c in children if c not in " \t\n\x0b\x0c\r")
        chars = {c: i for i, c in enumerate(sorted(most, key=lambda c: (not c.isascii(), -most[c], c))[: CLASSES - 1], 1)}
        out = np.zeros((len(self.next), CLASSES), np.uint32)
        for c, i in chars.items():
            out[0, i] = len(c.encode())
        todo = deque([0])
        while todo:  # breadth first: the link of a node comes before it
            node = todo.popleft()
            if node:
                ends[node] = self.pop[node] + ends[self.link[node]]
                out[node] = out[self.link[node]] + np.uint32(self.pop[node])
            for c, to in self.next[node].items():
                todo.append(to)
                if c in chars:
                    out[node, chars[c]] = to << 8
        if max(ends) > 250 or len(self.next) >= 1 << 24:
            return None
        kinds = np.zeros(0x110000, np.uint8)
        kinds[[ord(c) for c in chars]] = list(chars.values())
        kinds[[ord(c) for c in " \t\n\x0b\x0c\r"]] = BLANK
        return kinds, out.ravel(), np.array(ends, np.int64)

    def counts(self, texts: list[str], known: dict[str, int]) -> tuple[list[int], list[int]]:
        """Numbers of words and of tokens of some texts. known: words that were read one by one, and gets more."""
        kinds, table, ends = self.table
        both = "\n".join(texts)
        kind = kinds[np.frombuffer(both.encode("utf-32-le"), "<u4")]
        blank = np.concatenate([[True], kind == BLANK, [True]])
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        low, high = edge[::2], edge[1::2]
        size = high - low
        other = np.concatenate([[0], np.cumsum(kind == 0)])
        odd = (size > LONG) | (other[high] > other[low])
        tokens = np.zeros(len(low) + 1, np.int64)
        for i in np.flatnonzero(odd).tolist():
            word = both[low[i] : high[i]]
            if (n := known.get(word)) is None:
                n = known[word] = self.count(word)
            tokens[i + 1] = n
        rows = np.flatnonzero(~odd)
        rows = rows[np.argsort(LONG - size[rows], kind="stable")]  # the longest first, so that those still read are in front
        at, start = low[rows], self.next[0].get(self.mark, 0)
        state, n = np.full(len(rows), start, np.int64), np.full(len(rows), 0 if start else len(self.mark.encode()), np.int64)
        left = len(rows) - np.cumsum(np.bincount(size[rows], minlength=1))
        for i in range(len(left) - 1):
            m = left[i]
            found = table[state[:m] * CLASSES + kind[at[:m] + i]]
            state[:m] = found >> np.uint32(8)
            n[:m] += found & np.uint32(255)
        tokens[rows + 1] = n + ends[state]
        first = np.searchsorted(low, np.cumsum([0, *(len(x) + 1 for x in texts)]))
        return np.diff(first).tolist(), np.diff(np.cumsum(tokens)[first]).tolist()

    def count(self, word: str) -> int:
        """Tokens of one word."""
        follow, link, pop, n, at = self.next, self.link, self.pop, 0, 0
        for c in self.mark + word:
            while (to := follow[at].get(c)) is None and at:
                n += pop[at]
                at = link[at]
            if to is None:
                n += len(c.encode())
            else:
                at = to
        while at:
            n += pop[at]
            at = link[at]
        return n


@lru_cache(2)
def load(model_path: str) -> tuple[Automaton, dict[str, int]]:
    """Automaton over the pieces of a sentencepiece model, and the counts so far."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Automaton(pieces), {}


def counter(model_path: str) -> Callable[[list[bytes]], tuple[list[int], list[int]]]:
    """A function from texts to their numbers of words and of tokens."""

    def count(texts: list[bytes]) -> tuple[list[int], list[int]]:
        automaton, known = load(model_path)
        words, tokens, group, size = [], [], [], 0

        def read() -> None:
            if len(known) > CACHED:
                known.clear()
            if automaton.table is None:
                found = [[automaton.count(w.decode("utf-8", "replace")) for w in x.encode().split()] for x in group]
                found = [len(x) for x in found], [sum(x) for x in found]
            else:
                found = automaton.counts(group, known)
            words.extend(found[0])
            tokens.extend(found[1])
            group.clear()

        for text in texts:
            text = text.decode("utf-8", "replace")
            if group and size + len(text) > GROUP:
                read()
                size = 0
            group.append(text)
            size += len(text)
        if group:
            read()
        return words, tokens

    return count


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text."""
    count = counter(model_path)

    def one(batch: pa.RecordBatch) -> dict:
        words, tokens = count(texts_of(batch))
        return {"doc_id": batch.column(0), "n_words": words, "n_tokens": tokens}

    return map_batches(id_text(docs), one, "doc_id long, n_words long, n_tokens long")
