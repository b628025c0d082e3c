"""Token counts of a unigram tokenizer by dynamic programming over a trie of distinct pre-tokens.

Each pre-token is inserted into a trie once; a new node's forward score is the best segmentation of its prefix, computed
from its ancestors', so a prefix shared by many pre-tokens is scored once. A terminal keeps its token count, and
a document's count is the sum of its pre-tokens' terminals. Every worker keeps its own trie: nothing is shuffled.
"""

from __future__ import annotations

import base64
import math
import sys
import types
from collections import deque
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package

#: Nodes and terminals a worker keeps before it starts anew, which costs time and changes no count.
NODES = 1_500_000
#: Longer pre-tokens (bytes) are not put into the trie.
LONG = 1000


def zipf_scores(path: str) -> dict[bytes, float]:
    """piece -> log probability of a public byte-complete vocabulary, by its frequency rank: p ~ 1 / (rank + 2.7).
    The file lists base64 pieces and ranks; no tokenizer is trained."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    z = math.log(math.fsum(1 / (r + 2.7) for r in ranks.values()))
    return {piece: -math.log(r + 2.7) - z for piece, r in ranks.items()}


class Trie(dict):
    """pre-token -> token count (terminals); the nodes hold the forward scores."""

    def __init__(self, scores: dict[bytes, float]) -> None:
        if any(bytes([b]) not in scores for b in range(256)):
            raise ValueError("a vocabulary needs every single byte")
        #: every end of a piece, and its score if it is a piece itself: reading backwards stops where nothing ends so
        self.ends: dict[bytes, float | None] = {p[i:]: None for p in scores for i in range(1, len(p))}
        self.ends.update(scores)
        self.longest = max(map(len, scores))
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.child: dict[int, int] = {}
        self.best: list[tuple[float, int]] = [(0.0, 0)]  # (forward score, minus tokens): of equal scores the fewer tokens win

    def _score(self, raw: bytes, i: int, before) -> tuple[float, int]:
        """The best way to cut raw[:i]; before[j - i] is that of raw[:j]."""
        ends, top = self.ends, (-math.inf, 0)
        for j in range(i - 1, max(0, i - self.longest) - 1, -1):
            s = ends.get(raw[j:i], math.inf)
            if s is None:
                continue
            if s == math.inf:
                break
            f = before[j - i]
            c = (f[0] + s, f[1] - 1)
            if c > top:
                top = c
        return top

    def __missing__(self, pre: str) -> int:
        raw = pre.encode("utf-8", "surrogatepass")
        if len(raw) > LONG:  # scored in a sliding window, without nodes
            window = deque([(0.0, 0)], maxlen=self.longest)
            for i in range(1, len(raw) + 1):
                window.append(self._score(raw, i, window))
            return -window[-1][1]
        node, path = 0, [(0.0, 0)]
        child, best = self.child, self.best
        for i, byte in enumerate(raw, 1):
            nxt = child.get(node << 8 | byte)
            if nxt is None:
                nxt = len(best)
                best.append(self._score(raw, i, path))
                child[node << 8 | byte] = nxt
            node = nxt
            path.append(best[node])
        n = -best[node][1]
        if len(pre) <= 64:  # longer ones rarely come twice
            self[pre] = n
        return n


def _trie(path: str) -> Trie:
    home = sys.modules.setdefault("_comboscan_tries", types.ModuleType("_comboscan_tries"))
    if not hasattr(home, path):
        setattr(home, path, Trie(zipf_scores(path)))
    trie = getattr(home, path)
    if len(trie.best) > NODES:
        trie.reset()
    return trie


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Carried columns, pre_tokens and tokens (long) of each whole text; null and empty texts have 0 of both.

    Repeated rows give repeated rows; an empty table gives none; other columns are not read. A pre-token of any length takes memory for
    its own bytes and one window of scores.
    """
    ship_package(docs.sparkSession)
    find = regex.compile(pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pre, tokens = [], []
            for at, t in enumerate(pdf.pop("_text")):
                if at % 512 == 0:
                    trie = _trie(vocabulary)
                parts = find.findall(t) if t else []
                pre.append(len(parts))
                tokens.append(sum(map(trie.__getitem__, parts)))
            yield pdf.assign(pre_tokens=pre, tokens=tokens)

    src = docs.select(*[F.col(c).cast("string").alias(c) for c in carry], F.col(text).alias("_text"))
    out = src.mapInPandas(run, ", ".join([f"`{c}` string" for c in carry] + ["pre_tokens long", "tokens long"]))
    return out.select(*[F.col(c).cast(docs.schema[c].dataType).alias(c) for c in carry], "pre_tokens", "tokens")
