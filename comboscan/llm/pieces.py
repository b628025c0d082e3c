"""SentencePiece encoding and decoding with source offsets: longest-prefix normalisation, BPE merges, pieces projected to byte spans.

The normaliser reads the model's compiled character map (a double-array trie over UTF-8 bytes and its replacement strings) and
takes the longest rule at each place; every normalised byte remembers the source byte its rule began at, so a piece's span in the
source is looked up at its two ends. Merges run once for each distinct chunk of a worker, as no piece of such models reaches over the
start of a word.
"""

from __future__ import annotations

import heapq
import re
import sys
import types
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship_package

SPACE = "▁"
#: Chunks, and their characters, in each of a worker's two memories of ids: when the younger is full the older is forgotten.
KNOWN, KNOWN_CHARS = 350_000, 6_000_000
#: Letters up to which the next merge is found by a look at all neighbours, not by a heap.
SHORT = 40
#: Bytes of text that are encoded at a time, a longer text alone.
SLICE = 4 << 20
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def read_charsmap(blob: bytes) -> dict[str, str]:
    """source -> replacement of every rule of a compiled character map; empty for an empty map.

    The map is the trie's size, the trie's 32-bit units, then replacements that end at a zero byte. A unit's low byte is its
    label, bit 8 says that the key may end there, bits 10 up and bit 9 give the offset of its children.
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
    below = lambda at, unit: at ^ ((unit >> 10) << ((unit & 512) >> 6))
    rules, todo = {}, [(below(0, units[0]), b"")]
    while todo:
        base, key = todo.pop()
        for byte in range(1, 256):
            at = base ^ byte
            if at >= len(units) or units[at] & 0x800000FF != byte:
                continue
            child, word = below(at, units[at]), key + bytes([byte])
            if units[at] >> 8 & 1:
                start = units[child] & 0x7FFFFFFF
                rules[word] = texts[start : texts.index(b"\0", start)].decode()
            todo.append((child, word))
    return {k.decode(): v for k, v in rules.items()}


class Normalizer:
    """Text to (normalised text, source byte of each normalised byte, and one more for the end)."""

    def __init__(self, rules: dict[str, str], dummy_prefix: bool, squeeze: bool, escape: bool, suffix: bool = False, verbatim: tuple[str, ...] = ()) -> None:
        self.rules = rules | {v: v for v in verbatim}
        self.verbatim = tuple(sorted(verbatim, key=len, reverse=True))
        self.dummy, self.squeeze, self.escape, self.suffix = dummy_prefix, squeeze, escape, suffix
        self.longest: dict[str, int] = {}
        for k in self.rules:
            self.longest[k[0]] = max(self.longest.get(k[0], 0), len(k))
        self.starts = re.compile("[" + "".join(map(re.escape, sorted(self.longest))) + "]") if self.longest else None

    def steps(self, text: str) -> Iterator[tuple[str, str, bool]]:
        """(source, replacement, whether a rule made it): stretches without a rule as they are, else the longest rule at a place."""
        at, n = 0, len(text)
        while at < n:
            hit = self.starts.search(text, at) if self.starts else None
            begin = hit.start() if hit else n
            if begin > at:
                yield text[at:begin], text[at:begin], False
            if hit is None:
                return
            own = next((v for v in self.verbatim if text.startswith(v, begin)), None)
            top = self.longest[text[begin]]
            key = own or next((k for m in range(min(top, n - begin), 0, -1) if (k := text[begin : begin + m]) in self.rules), None)
            if key is None:
                yield text[begin], text[begin], False
                at = begin + 1
            else:
                yield key, self.rules[key], True
                at = begin + len(key)

    def plain(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text before spaces are escaped, with the source byte of each of its bytes and the end's."""
        if self.starts is None or self.starts.search(text) is None:
            raw = np.frombuffer(text.encode(), np.uint8)
            return text, np.append(_starts(raw), len(raw))
        out, places, at = [], [], 0
        for source, new, ruled in self.steps(text):
            raw = np.frombuffer(source.encode(), np.uint8)
            places.append(np.full(len(new.encode()), at) if ruled else _starts(raw) + at)
            out.append(new)
            at += len(raw)
        return "".join(out), np.append(np.concatenate(places), at)

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        if not text:
            return "", np.zeros(1, np.int64)
        norm, places = self.plain(text)
        if self.squeeze:
            norm, places = self._squeezed(norm, places)
            if not norm:
                return "", places
        mark = SPACE if self.escape else " "
        wide = len(mark.encode())
        if self.escape and " " in norm:
            places = np.append(np.repeat(places[:-1], np.where(np.frombuffer(norm.encode(), np.uint8) == 32, wide, 1)), places[-1])
            norm = norm.replace(" ", SPACE)
        if self.dummy and not self.suffix:
            norm, places = mark + norm, np.concatenate([np.full(wide, places[0]), places])
        while self.squeeze and norm.endswith(mark):
            norm, places = norm[: -len(mark)], places[:-wide]
        if self.dummy and self.suffix:
            norm, places = norm + mark, np.concatenate([places[:-1], np.full(wide, places[-1]), places[-1:]])
        return norm, places

    @staticmethod
    def _squeezed(norm: str, places: np.ndarray) -> tuple[str, np.ndarray]:
        """No leading space and no second one in a row; nothing at all of a text of spaces."""
        if not norm.strip(" "):
            return "", np.zeros(1, np.int64)
        raw = np.frombuffer(norm.encode(), np.uint8)
        space = raw == 32
        keep = ~(space & np.concatenate([[True], space[:-1]]))
        return raw[keep].tobytes().decode(), places[np.append(keep, True)]


def _starts(raw: np.ndarray) -> np.ndarray:
    """For each byte the first byte of its character."""
    at = np.arange(len(raw))
    return np.maximum.accumulate(np.where((raw & 0xC0) != 0x80, at, 0)) if len(raw) else at


@dataclass
class Encoded:
    """Ids of a text without begin and end, and the source bytes each covers."""

    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


class Pieces:
    """The BPE model of a file: ids, source spans and decoding, as the model's own library gives them."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            model = proto.ModelProto.FromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != spec.BPE:
            raise ValueError(f"{path} is no BPE model")
        kinds = [p.type for p in model.pieces]
        names = [p.piece for p in model.pieces]
        self.kinds, self.names = kinds, names
        self.score = {n: p.score for n, p, k in zip(names, model.pieces, kinds) if k in (NORMAL, USER, UNUSED)}
        self.id = {n: i for i, (n, k) in enumerate(zip(names, kinds)) if k in (NORMAL, USER, UNUSED)}
        self.unused = {n for n, k in zip(names, kinds) if k == UNUSED}
        self.user = tuple(n for n, k in zip(names, kinds) if k == USER)
        self.unk = kinds.index(UNKNOWN)
        self.bytes = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(names, kinds)) if k == BYTE} if spec.byte_fallback else {}
        self.bos, self.eos = (names.index(n) if n in names else None for n in (spec.bos_piece, spec.eos_piece))
        self.normalize = Normalizer(read_charsmap(norm.precompiled_charsmap), norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces, spec.treat_whitespace_as_suffix, self.user)
        self.strip = norm.add_dummy_prefix or norm.remove_extra_whitespaces
        self.strip_all = norm.remove_extra_whitespaces
        self.unk_surface = spec.unk_surface
        # a piece with a space behind another letter would reach over the start of a word
        words = all(SPACE not in n.lstrip(SPACE) for n in self.score)
        user = "|".join(map(re.escape, sorted(self.user, key=len, reverse=True)))
        self.chunk = re.compile((f"{user}|" if user else "") + (f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if words and not user else r"(?s:.+)"))
        self.user_split = re.compile(f"({user})") if user else None
        #: surface bytes of each id for decoding; controls have none
        self.surface = [b"" if k == CONTROL else bytes([int(n[3:5], 16)]) if k == BYTE else spec.unk_surface.encode() if k == UNKNOWN else n.replace(SPACE, " ").encode() for n, k in zip(names, kinds)]
        self.size = np.array([len(n.encode()) for n in names], np.int64)
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.byte_value = np.array([int(n[3:5], 16) if k == BYTE else 0 for n, k in zip(names, kinds)])
        self.pairs = set() if self.user else {a + b for n in self.score for a, b in zip(n, n[1:])}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chars = 0

    def merge(self, chunk: str) -> list[str]:
        """Pieces of a chunk: neighbours merge by the best score, the leftmost of equals first; pieces out of use are split again."""
        if not self.user and not self.unused and len(chunk) <= SHORT:
            return self._merge_short(list(chunk))
        part: list[str | None] = []
        frozen: list[bool] = []
        for i, s in enumerate(self.user_split.split(chunk) if self.user_split else [chunk]):
            part += [s] if i % 2 else list(s)
            frozen += [True] if i % 2 else [False] * len(s)
        n = len(part)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, int]] = []
        made: dict[str, tuple[str, str]] = {}

        def offer(a: int, b: int) -> None:
            if a < 0 or b < 0 or frozen[a] or frozen[b]:
                return
            word = part[a] + part[b]
            score = self.score.get(word)
            if score is not None:
                heapq.heappush(heap, (-score, a, b, len(word)))
                if word in self.unused:
                    made[word] = (part[a], part[b])

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if part[a] is None or part[b] is None or len(part[a]) + len(part[b]) != size:
                continue
            part[a] += part[b]
            part[b] = None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        out, todo = [], [p for p in reversed(part) if p is not None]
        while todo:
            p = todo.pop()
            if p in made and p in self.unused:
                todo += [made[p][1], made[p][0]]
            else:
                out.append(p)
        return out

    def _merge_short(self, part: list[str]) -> list[str]:
        """The same merges, the best found by looking at every neighbour: faster for a word's few letters."""
        score, none = self.score.get, float("-inf")
        near = [score(a + b, none) for a, b in zip(part, part[1:])]
        near.append(none)
        while (best := max(near)) > none:
            i = near.index(best)
            word = part[i] = part[i] + part.pop(i + 1)
            del near[i]
            if i + 1 < len(part):
                near[i] = score(word + part[i + 1], none)
            if i:
                near[i - 1] = score(part[i - 1] + word, none)
        return part

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk, packed; a letter of no piece is its bytes, or the unknown piece. Two letters that stand together in no
        piece are never merged, so a word and the marks about it are looked up apart."""
        if self.pairs and not chunk[1:].isalpha():
            cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in self.pairs]
            if cuts:
                return b"".join([self._remembered(chunk[a:b]) for a, b in zip([0, *cuts], [*cuts, len(chunk)])])
        parts = self.merge(chunk)
        try:
            return array("I", [self.id[p] for p in parts]).tobytes()
        except KeyError:
            ids: list[int] = []
            for p in parts:
                ids += [self.id[p]] if p in self.id else [self.bytes[b] for b in p.encode()] if self.bytes else [self.unk]
            return array("I", ids).tobytes()

    def _remembered(self, chunk: str) -> bytes:
        """Ids of a chunk that the younger memory lacks, from the older one or anew; a full younger memory becomes the older one."""
        got = self.known.get(chunk) or self.older.get(chunk) or self._chunk(chunk)
        if len(self.known) >= KNOWN or self.chars >= KNOWN_CHARS:
            self.older, self.known, self.chars = self.known, {}, 0
        self.known[chunk] = got
        self.chars += len(chunk)
        return got

    def chunks(self, norm: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, normalised bytes of each piece) of a normalised text. Byte pieces of one letter count all its bytes at the last."""
        cuts = self.chunk.findall(norm)
        found = [self.known.get(c) or self._remembered(c) for c in cuts]
        ids = np.frombuffer(b"".join(found), "<u4")
        sizes = self.size[ids]
        if self.bytes:
            at = np.flatnonzero(self.is_byte[ids])
            if len(at):
                # the bytes of a letter stand together, led by one that says how many there are
                value = self.byte_value[ids[at]]
                lead = (value & 0xC0) != 0x80
                width = 1 + (value[lead] >= 0xC0) + (value[lead] >= 0xE0) + (value[lead] >= 0xF0)
                sizes[at] = 0
                sizes[at[lead] + width - 1] = width
        else:
            sizes = self._unknown_sizes(norm, cuts, ids, sizes)
            if len(ids) > 1:  # unknown letters in a row are one piece
                same = (ids[1:] == self.unk) & (ids[:-1] == self.unk)
                first = np.flatnonzero(np.concatenate([[True], ~same]))
                ids, sizes = ids[first], np.add.reduceat(sizes, first)
        return ids, sizes

    def _unknown_sizes(self, norm: str, cuts: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The sizes with those of unknown pieces, of models without byte pieces."""
        at = np.flatnonzero(ids == self.unk)
        if len(at):
            sizes[at] = [len(p.encode()) for c in cuts for p in self.merge(c) if p not in self.id]
        return sizes

    def encode(self, text: str | None) -> Encoded:
        """Ids and source spans of a whole text; of a letter's byte pieces the last one has its span, the others an empty one before it."""
        norm, places = self.normalize(text or "")
        ids, sizes = self.chunks(norm)
        upto = np.cumsum(sizes)
        return Encoded(ids, places[upto - sizes], places[upto])

    def framed(self, ids: np.ndarray) -> np.ndarray:
        """Ids with the model's begin and end."""
        return np.concatenate([np.array([self.bos], "<u4"), ids.astype("<u4"), np.array([self.eos], "<u4")])

    def decode(self, ids: np.ndarray) -> str:
        """Text of any ids: begin's space is dropped, byte pieces become letters, and each byte that is part of none a replacement mark."""
        listed, surface, kinds = ids.tolist(), self.surface, self.kinds
        out = [surface[i] for i in listed]
        if self.strip:
            for at, i in enumerate(listed):
                if kinds[i] == CONTROL:
                    continue
                text = self.names[i] if kinds[i] in (NORMAL, USER, UNUSED) else ""
                cut = text.startswith(SPACE)
                out[at] = out[at][1:] if cut else out[at]
                if out[at] or (cut and not self.strip_all):
                    break
        raw = b"".join(out)
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_bytes(listed, out)

    def _decode_bytes(self, listed: list[int], out: list[bytes]) -> str:
        text, run = [], bytearray()

        def close() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        text.append(bytes(run[at : at + n]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text.append("�")
                    n = 1
                at += n
            run.clear()

        for i, s in zip(listed, out):
            if self.kinds[i] == BYTE:
                run += s
            else:
                close()
                text.append(s.decode())
        close()
        return "".join(text)


def pieces(path: str) -> Pieces:
    """One model for each worker process and file."""
    home = sys.modules.setdefault("_comboscan_pieces", types.ModuleType("_comboscan_pieces"))
    if not hasattr(home, path):
        setattr(home, path, Pieces(path))
    return getattr(home, path)


def slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``limit`` bytes of text; a longer text is a part of its own."""
    column = batch.column(batch.schema.get_field_index(text))
    start, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def encode(docs: DataFrame, model: str, text: str = "text", spans: bool = True) -> DataFrame:
    """All columns of ``docs``, then ``ids``, ``begins``, ``ends`` and ``decoded`` of each whole text.

    ``ids`` are with begin and end, packed as little-endian unsigned 32-bit integers; ``begins`` and ``ends`` (likewise packed, null without
    ``spans``) are the source bytes of each piece, empty spans for begin and end; ``decoded`` is the text of the ids. A null text
    is encoded as the empty one: begin and end only. Repeated rows and null ids are rows like any other; an empty table gives no rows;
    columns of ``docs`` that bear one of the new names are kept and the new ones get a trailing underscore. Texts of any length are
    encoded whole, one at a time beyond 4 MB. Map only.
    """
    ship_package(docs.sparkSession)
    names = [fresh(n, docs.columns) for n in ("ids", "begins", "ends", "decoded")]
    key = fresh("_text", docs.columns)
    types_ = ["binary", "binary", "binary", "string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            for part in slices(batch, key, SLICE):
                rows: list[tuple] = []
                for t in part.column(part.schema.get_field_index(key)).to_pylist():
                    e = own.encode(t)
                    ids = own.framed(e.ids)
                    last = int(e.ends[-1]) if len(e.ends) else 0
                    places = [np.concatenate([[0], x, [last]]).astype("<u4").tobytes() for x in (e.begins, e.ends)] if spans else [None, None]
                    rows.append((ids.tobytes(), *places, own.decode(ids)))
                new = [pa.array(c, pa.string() if k == "string" else pa.binary()) for c, k in zip(zip(*rows), types_)]
                kept = [part.column(i) for i, f in enumerate(part.schema) if f.name != key]
                yield pa.RecordBatch.from_arrays([*kept, *new], [*(f.name for f in part.schema if f.name != key), *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema = fields + ", " + ", ".join(f"`{n}` {t}" for n, t in zip(names, types_))
    return docs.withColumn(key, F.col(f"`{text}`")).mapInArrow(run, schema)
