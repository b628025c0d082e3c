"""Hierarchical multi-length packing of tokenized documents, one streamed pass per input partition.

Documents are cut into full longest windows; what is left goes to the tier (2048, 1024, 512 or 256 tokens) whose window
it more than half fills. Each tier is packed from the longest down, its gaps filled from shorter tiers, whole pieces
first and a cut only when none fits. What still leaves a gap is carried into the next batch of documents; the last
tail of a partition becomes windows of powers of two. Windows of a tier are dealt into step groups of equal tokens.
Nothing is shuffled, and a lost task repeats its own partition with the same result.
"""

from __future__ import annotations

import json
import os
import sys
import types
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package

WINDOW = 2048
TIERS = (2048, 1024, 512, 256)
#: Tokens of a step group: sequences of one tier that make up one training step.
STEP = 16 * WINDOW
#: Documents that are cut up and packed at a time.
SLICE = 2000
EOS = 1


def byte_letters() -> dict[int, str]:
    """The letter a byte-level vocabulary shows each byte as: printable Latin-1 as itself, the others from code point 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


def merge_ranks(config: dict) -> dict[bytes, int] | None:
    """piece -> id of a plain byte-level model whose merges stand in the order of the ids they make; None for any other model.

    For such a model the lowest id among all neighbouring pairs is the next merge, so a rank table says all the merges do.
    """
    model, level = config["model"], config["pre_tokenizer"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if not plain or config.get("normalizer") or not level or level["type"] != "ByteLevel" or level["add_prefix_space"] or not level["use_regex"]:
        return None
    ids, bytes_of = model["vocab"], {c: b for b, c in byte_letters().items()}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [ids[a + b] for a, b in merges]
    if made != sorted(set(made)) or len(made) + 256 != len(ids) or any(not set(s) <= bytes_of.keys() for s in ids):
        return None
    return {bytes(bytes_of[c] for c in s): i for s, i in ids.items()}


class Encoder:
    """Ids of whole texts as little-endian bytes, by the tokenizer of a file. Plain byte-level models run on their rank table
    (same ids, a fraction of the time); any other model runs as the file says."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranked = None
        config = json.loads(self.tokenizer.to_str())
        ranks = merge_ranks(config)
        if ranks is not None:
            import tiktoken

            special = {t["content"]: t["id"] for t in config["added_tokens"]}
            plain = not any(t[k] for t in config["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
            if plain and not set(special.values()) & set(ranks.values()):
                self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode_one(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.ranked is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.ranked.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null and empty texts have none; copies are encoded once."""
        ids = {t: self.encode_one(t) for t in dict.fromkeys(texts)}
        return [ids[t] for t in texts]


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    home = sys.modules.setdefault("_comboscan_encoders", types.ModuleType("_comboscan_encoders"))
    if not hasattr(home, path):
        setattr(home, path, Encoder(path))
    return getattr(home, path)


class Packer:
    """Packs pieces (length, document, start) into windows; keeps what does not fill one until more comes."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.held: list[tuple[int, int, int]] = []

    def _fill(self, room: int, pool: list[tuple[int, int, int]], top: int) -> list[tuple[int, int, int]]:
        """Pieces for ``room`` tokens from pool[:top]: the longest that fits, else a cut of the shortest."""
        out = []
        while room and top:
            i = bisect_right(pool, (room, sys.maxsize, sys.maxsize), 0, top)
            if i:
                piece = pool.pop(i - 1)
                out.append(piece)
                room -= piece[0]
                top -= 1
            else:
                n, doc, start = pool.pop(0)
                out.append((room, doc, start))
                insort(pool, (n - room, doc, start + room))
                room = 0
        return out

    def pack(self, pieces: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
        longest, done = self.tiers[0], []
        pool = []
        for n, doc, start in pieces + self.held:
            while n >= longest:
                done.append((longest, [(longest, doc, start)]))
                n, start = n - longest, start + longest
            if n:
                pool.append((n, doc, start))
        pool.sort()
        self.held = []
        for tier, below in zip(self.tiers, [*self.tiers[1:], 0]):
            while pool and pool[-1][0] > below:
                head = pool.pop()
                window = [head]
                room = tier - head[0]
                window += self._fill(room, pool, bisect_left(pool, (below + 1,)))
                room = tier - sum(p[0] for p in window)
                window += self._fill(room, pool, len(pool))
                if sum(p[0] for p in window) == tier:
                    done.append((tier, window))
                else:
                    self.held += window
        return done

    def rest(self) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """The held tail as full windows of powers of two, longest first."""
        done, pool = [], sorted(self.held, reverse=True)
        left = sum(p[0] for p in pool)
        while left:
            size = min(self.tiers[0], 1 << (left.bit_length() - 1))
            window, room = [], size
            while room:
                n, doc, start = pool.pop(0)
                take = min(n, room)
                window.append((take, doc, start))
                room -= take
                if n > take:
                    pool.insert(0, (n - take, doc, start + take))
            done.append((size, window))
            left -= size
        self.held = []
        return done


SCHEMA = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, step: int = STEP) -> DataFrame:
    """One row for each piece of each document (doc_id, text): where it starts, its length and checksum, and its place.

    A document's ids are its text's plus the end id, so a null or empty text is one token. Every id lies in exactly one piece;
    every sequence is full: its tokens are a tier or, at a partition's end, a power of two. Repeated rows and null ids are
    documents like any other; an empty table gives no rows; other columns are not read. sequence_id is unique over
    all partitions; step_group numbers groups of one tier whose sequences add up to ``step`` tokens.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, packer = encoder(tokenizer), Packer(tiers)
        base = TaskContext.get().partitionId() << 40
        known: dict[int, tuple[object, bytes]] = {}
        state = {"doc": 0, "seq": 0, "group": 0}
        steps: dict[int, tuple[int, int]] = {}  # tier -> (tokens so far, group)

        def rows(windows) -> pd.DataFrame:
            out = []
            for size, window in windows:
                seq = base + state["seq"]
                state["seq"] += 1
                used, group = steps.get(size, (step, 0))
                if used + size > step:
                    used, group = 0, base + state["group"]
                    state["group"] += 1
                steps[size] = (used + size, group)
                offset = 0
                for n, doc, start in window:
                    doc_id, ids = known[doc]
                    out.append((doc_id, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), len(ids) // 4, seq, offset, size, group))
                    offset += n
            return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"])

        end = EOS.to_bytes(4, "little")
        for pdf in batches:
            for at in range(0, len(pdf), SLICE):
                texts, fresh = pdf["text"].iloc[at : at + SLICE].tolist(), []
                for doc_id, ids in zip(pdf["doc_id"].iloc[at : at + SLICE].tolist(), enc.encode(texts)):
                    known[state["doc"]] = (doc_id, ids + end)
                    fresh.append((len(ids) // 4 + 1, state["doc"], 0))
                    state["doc"] += 1
                yield rows(packer.pack(fresh))
                open_docs = {p[1] for p in packer.held}
                known = {d: v for d, v in known.items() if d in open_docs}
        yield rows(packer.rest())

    # ids travel as text: pandas would turn integers beside a null into doubles
    out = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, SCHEMA)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
