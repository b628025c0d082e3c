"""Alignment of two tokenizations of the same bytes: shared boundaries, overlapping token pairs, and how many documents hold each pair.

Blocks of documents are aligned inside Arrow tasks by DuckDB: both tokenizations are interval tables on one byte axis, an as-of join
finds the first and the last piece that each token meets, a join over that range lists the links, and running sums over shared
ends number the groups. A text is cut where a piece with a space begins and a token ends: no group or link reaches over such a
place, so each distinct stretch of a block is aligned once, in tables of bounded size whatever the text's length. Each
block gives its documents' links and its partial pair counts; Spark merges the counts and brings them back to the blocks that hold the pair.
"""

from __future__ import annotations

import hashlib
import sys
import tempfile
import types
from array import array
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, ship_package
from .packing import Encoder
from .pieces import SPACE, slices

#: Bytes of text in a block; a longer text is a block of its own. A block's distinct pairs are bounded by its text.
BLOCK = 1 << 20
#: Tokens whose stretches are aligned at a time; a longer stretch alone.
TOKENS = 150_000
#: Memory of a task's DuckDB; beyond it DuckDB spills.
DUCK = "256MB"

SQL = """
CREATE OR REPLACE TEMP TABLE a AS
  SELECT t.*, sum(CAST(o.e IS NOT NULL AS INT)) OVER (ORDER BY t.pos ROWS UNBOUNDED PRECEDING) - CAST(o.e IS NOT NULL AS INT) AS grp FROM a_in t LEFT JOIN b_in o ON o.e = t.e;
CREATE OR REPLACE TEMP TABLE b AS
  SELECT t.*, sum(CAST(o.e IS NOT NULL AS INT)) OVER (ORDER BY t.pos ROWS UNBOUNDED PRECEDING) - CAST(o.e IS NOT NULL AS INT) AS grp FROM b_in t LEFT JOIN a_in o ON o.e = t.e;
CREATE OR REPLACE TEMP TABLE met AS
  SELECT a.unit, a.id, lo.pos AS lo, hi.pos AS hi FROM a ASOF JOIN b lo ON a.s >= lo.s ASOF JOIN (SELECT pos, s + 1 AS s FROM b) hi ON a.e >= hi.s;
INSERT INTO links
  SELECT m.unit, m.a, b.id AS b, count(*) AS n FROM (SELECT unit, id AS a, unnest(range(lo, hi + 1)) AS pos FROM met) m JOIN b USING (pos) GROUP BY ALL;
"""
HELD = "CREATE OR REPLACE TEMP TABLE d AS SELECT doc, a, b, sum(n)::INT AS n FROM spots JOIN links USING (unit) GROUP BY doc, a, b"
LINKS = "SELECT doc, sum(n)::BIGINT AS n_links, list(a ORDER BY a, b) AS a, list(b ORDER BY a, b) AS b, list(n ORDER BY a, b) AS n FROM d GROUP BY doc ORDER BY doc"
PAIRS = "SELECT a, b, sum(times)::INT AS n FROM d JOIN held USING (doc) GROUP BY a, b ORDER BY a, b"
#: Rows of documents first, then one row with the block's distinct pairs and how many of its documents hold each.
ROW = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))]
SPARK_ROW = "n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, b array<int>, n array<int>"


class Side:
    """Ids of all texts by one tokenizer, and where each stretch starts."""

    def __init__(self, ids: np.ndarray, start: np.ndarray) -> None:
        self.ids, self.start = ids, start
        self.length = np.diff(np.append(start, len(ids)))

    def code(self) -> np.ndarray:
        """A code of each stretch's ids and their order."""
        place = np.arange(len(self.ids)) - np.repeat(self.start, self.length)
        mixed = (self.ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * (2 * place.astype(np.uint64) + np.uint64(0xBF58476D1CE4E5B9))
        return np.add.reduceat((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB), self.start)

    def places(self, stretch: np.ndarray) -> np.ndarray:
        """Where the ids of these stretches lie, one stretch after the other."""
        n = self.length[stretch]
        return np.repeat(self.start[stretch] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    def equal(self, same: np.ndarray) -> bool:
        """Whether each stretch has the ids of the one named for it."""
        return bool((self.length == self.length[same]).all()) and bool((self.ids == self.ids[self.places(same)]).all())

    def intervals(self, stretch: np.ndarray, size: np.ndarray, first: int) -> pa.Table:
        """(unit, pos, id, s, e) of these stretches' tokens on one byte axis."""
        flat = self.ids[self.places(stretch)]
        end = np.cumsum(size[flat])
        unit = np.repeat(np.arange(first, first + len(stretch), dtype=np.int32), self.length[stretch])
        return pa.table({"unit": unit, "pos": np.arange(len(flat)), "id": flat, "s": end - size[flat], "e": end})


class Aligner:
    """Both tokenizers and a DuckDB of one worker."""

    def __init__(self, byte_bpe: str, piece_bpe: str, groups: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.first, self.second, self.groups = Encoder(byte_bpe).ranked, sentencepiece.SentencePieceProcessor(model_file=piece_bpe), groups
        if self.first is None:
            raise ValueError(f"{byte_bpe} is no plain byte-level model")
        ranks, sp = self.first._mergeable_ranks, self.second
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.a_bytes[i] = raw
        with open(piece_bpe, "rb") as f:
            model = proto.ModelProto.FromString(f.read())
        norm = model.normalizer_spec
        # such a model changes nothing but a space and the mark that stands for one, so only a text with that mark is spelled otherwise
        self.faithful = model.trainer_spec.byte_fallback and norm.add_dummy_prefix and norm.escape_whitespaces and not (norm.precompiled_charsmap or norm.remove_extra_whitespaces)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if sp.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        ids = range(max(len(self.a_bytes), len(names)))
        self.plain, self.after_token, self.after_group, self.after_bar = (np.array([f"{x}{i}" for i in ids], object) for x in ("", ",", ";", "|"))
        self.begins = np.array([x.startswith(SPACE) for x in names])
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": DUCK, "temp_directory": tempfile.mkdtemp()})

    def tokens(self, text: str, b: list[int]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both tokenizers, special tokens' strings being plain text; None unless both spell a space and the text."""
        a = self.first.encode_to_numpy(" " + text, disallowed_special=()).astype("<i4", copy=False)
        if self.faithful:
            same = SPACE not in text
        else:  # a plain byte-level model spells what it is given
            same = b"".join([self.b_bytes[i] for i in b]) == (" " + text).encode()
        return (a, np.frombuffer(array("i", b), "<i4")) if same else None

    def stretches(self, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[Side, Side, np.ndarray]:
        """Both ids of all texts, cut at every text and before the pieces that begin with a space where a token ends, and for each stretch
        the number of the first equal one."""
        a, b = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        at = np.flatnonzero(self.begins[b])
        at = np.union1d(at, np.cumsum([0, *(len(x[1]) for x in found[:-1])]))  # every text begins with a space, in either model
        ends = b_end[at[1:] - 1]
        near = np.searchsorted(a_end, ends)
        ok = a_end[near] == ends
        sides = Side(a, np.concatenate([[0], near[ok] + 1])), Side(b, np.concatenate([[0], at[1:][ok]]))
        _, first, number = np.unique(sides[0].code() * np.uint64(31) + sides[1].code(), return_index=True, return_inverse=True)
        same = first[number]
        if not all(x.equal(same) for x in sides):  # two stretches of one code: none is taken for another
            same = np.arange(len(same))
        return *sides, same

    def align(self, a: Side, b: Side, units: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """(groups of each of these stretches, their text); the links go to the table ``links``."""
        con, counts, texts, at = self.con, [], [], 0
        con.execute("CREATE OR REPLACE TEMP TABLE links (unit INT, a INT, b INT, n BIGINT)")
        upto = np.cumsum(a.length[units] + b.length[units])
        while at < len(units):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TOKENS, "right")))
            con.register("a_in", a.intervals(units[at:to], self.a_size, at))
            con.register("b_in", b.intervals(units[at:to], self.b_size, at))
            con.execute(SQL)
            n, lines = self.written(*(con.execute(f"SELECT unit, id, grp::BIGINT AS grp FROM {t} ORDER BY pos").fetchnumpy() for t in "ab"))
            counts.append(n)
            texts += lines
            at = to
        return np.concatenate(counts), texts

    def written(self, a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> tuple[np.ndarray, list[str]]:
        """(groups, their text) of each stretch of tokens numbered by group, in order: group by group its a, a bar, its b."""
        many = [np.bincount(x["grp"], minlength=int(a["grp"][-1]) + 1) for x in (a, b)]
        place = np.empty(len(a["id"]) + len(b["id"]), object)
        starts = [np.concatenate([[True], x["grp"][1:] != x["grp"][:-1]]) for x in (a, b)]
        # a token stands behind all tokens of its side before it, and those of the other side's groups before its own
        first = np.arange(len(a["id"])) + (np.cumsum(many[1]) - many[1])[a["grp"]]
        second = np.arange(len(b["id"])) + np.cumsum(many[0])[b["grp"]]
        opens = np.concatenate([[True], a["unit"][1:] != a["unit"][:-1]])
        place[first] = np.where(opens, self.plain[a["id"]], np.where(starts[0], self.after_group[a["id"]], self.after_token[a["id"]]))
        place[second] = np.where(starts[1], self.after_bar[b["id"]], self.after_token[b["id"]])
        cuts = [*first[opens].tolist(), len(place)]
        flat = place.tolist()
        return np.bincount(a["unit"][starts[0]] - a["unit"][0]), ["".join(flat[i:j]) for i, j in zip(cuts, cuts[1:])]

    def block(self, texts: list[str | None]) -> tuple[pa.Table, tuple]:
        """(one row for each text, the block's pairs and the number of its texts that hold each); equal texts are aligned once."""
        wanted = list(dict.fromkeys(t for t in texts if t))
        found = {t: got for t, b in zip(wanted, self.second.encode(wanted, num_threads=1)) if (got := self.tokens(t, b)) is not None}
        doc = {t: i for i, t in enumerate(found)}
        empty = pa.table({k: pa.array([0], k_t) if k_t == pa.int64() else pa.array(["" if k_t == pa.string() else []], k_t) for k, k_t in ROW})
        if not doc:
            return pa.concat_tables([empty] * len(texts)), ([], [], [])
        left, right, same = self.stretches(list(found.values()))
        units, number = np.unique(same, return_inverse=True)
        counts, parts = self.align(left, right, units)
        con = self.con
        of = np.searchsorted(np.cumsum([len(x[0]) for x in found.values()]), left.start, "right").astype(np.int32)
        con.register("spots", pa.table({"doc": of, "unit": number.astype(np.int32)}))
        cuts = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
        spots = [number[i:j].tolist() for i, j in zip(cuts, [*cuts[1:], len(number)])]
        con.execute(HELD)
        links = con.sql(LINKS).to_arrow_table()
        whole = [";".join([parts[u] for u in x]) for x in spots]
        if self.groups == "sha256":
            whole = [hashlib.sha256(x.encode()).hexdigest() for x in whole]
        n = [[len(x[0]) for x in found.values()], [len(x[1]) for x in found.values()], [int(x) for x in np.add.reduceat(counts[number], cuts)]]
        values = [*n, links["n_links"], whole, links["a"], links["b"], links["n"]]
        per = pa.Table.from_arrays([v.cast(t) if isinstance(v, pa.ChunkedArray) else pa.array(v, t) for v, (_, t) in zip(values, ROW)], [k for k, _ in ROW])
        at = [doc.get(t, len(doc)) for t in texts]
        con.register("held", pa.table({"doc": np.arange(len(doc), dtype=np.int32), "times": np.bincount(np.array(at), minlength=len(doc) + 1)[: len(doc)]}))
        pairs = con.execute(PAIRS).fetchnumpy()
        return pa.concat_tables([per, empty]).combine_chunks().take(pa.array(at)), (pairs["a"], pairs["b"], pairs["n"])


def aligner(byte_bpe: str, piece_bpe: str, groups: str) -> Aligner:
    """One for each worker process and pair of files."""
    home = sys.modules.setdefault("_comboscan_aligners", types.ModuleType("_comboscan_aligners"))
    key = f"{byte_bpe}|{piece_bpe}|{groups}"
    if not hasattr(home, key):
        setattr(home, key, Aligner(byte_bpe, piece_bpe, groups))
    return getattr(home, key)


def align(docs: DataFrame, byte_bpe: str, piece_bpe: str, text: str = "text", groups: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, then n_a, n_b, n_groups, n_links, n_best, count_sum and groups of each document.

    A space and the text are encoded by ``byte_bpe`` (tokens a), the text by ``piece_bpe`` (tokens b, which adds the space). Groups lie
    between neighbouring byte offsets where tokens of both end: ``a1,a2|b1;a3|b2,b3`` in ids, or with ``groups`` "sha256" that string's
    digest. A link is a pair of occurrences whose bytes overlap; its count is the number of documents that hold the id pair linked. n_best is the
    number of links whose count no other pair of its a has more of, count_sum the sum over links. A text that is null,
    empty or not spelled alike by both has zeros and an empty string. Every row is a document, repeats and null ids
    too; an empty table gives no rows; a column of ``docs`` that bears one of the new names is kept and the new one gets a
    trailing underscore; a very long text is a block of its own.
    """
    ship_package(docs.sparkSession)
    kept = [c for c in docs.columns if c != text]
    mine, limit = {f"k{i}": c for i, c in enumerate(kept)}, BLOCK
    src = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in mine.items()], F.col(f"`{text}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_bpe, piece_bpe, groups)
        base, seen = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for part in slices(batch, "_text", limit):
                rows, pairs = own.block(part.column(len(mine)).to_pylist())
                block = base + seen
                seen += 1
                keys = [part.column(i) for i in range(len(mine))]
                one = lambda x: pa.array([x], pa.list_(pa.int32()))
                names = ["block", "doc", *mine, *(k for k, _ in ROW)]
                columns = [c for c in rows.combine_chunks().itercolumns()]
                columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, block)), pa.array(np.ones(part.num_rows, bool)), *keys, *columns], names)
                nothing = [pa.nulls(1, k.type) for k in keys] + [pa.nulls(1, t) for _, t in ROW[:5]]
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([False]), *nothing, *(one(p) for p in pairs)], names)

    fields = "".join(f"{k} {docs.schema[c].dataType.simpleString()}, " for k, c in mine.items())
    blocks = materialize(src.mapInArrow(run, f"block long, doc boolean, {fields}{SPARK_ROW}"), "aligned")
    pair = blocks.where("not doc").select(F.col("block").alias("held_by"), F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("held_by", "p.a", "p.b", "p.n")
    counts = materialize(pair.groupBy("a", "b").agg(F.sum(F.col("n").cast("long")).alias("docs")), "pairs")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    counts = counts.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))
    back = pair.select("held_by", "a", "b").join(counts, ["a", "b"])
    new = [fresh(n, kept) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")]

    def add(rows: pa.Table, found: pa.Table) -> pa.Table:
        key = (found["a"].to_numpy().astype(np.int64) << 32) | found["b"].to_numpy()
        order = np.argsort(key)
        key, docs_of, best = key[order], found["docs"].to_numpy()[order], found["best"].to_numpy()[order]
        a, b, n = (rows[c].combine_chunks() for c in ("a", "b", "n"))
        sizes = np.diff(a.offsets.to_numpy()) if len(a) else np.zeros(0, np.int64)
        a, b, n = (x.flatten().to_numpy().astype(np.int64) for x in (a, b, n))
        at = np.searchsorted(key, (a << 32) | b)
        row = np.repeat(np.arange(len(sizes)), sizes)
        total, top = (np.zeros(len(sizes), np.int64) for _ in range(2))
        if len(at):
            np.add.at(total, row, n * docs_of[at])
            np.add.at(top, row, n * best[at])
        keys = [rows[k] for k in mine]
        plain = [rows[k] for k in ("n_a", "n_b", "n_groups", "n_links")]
        return pa.Table.from_arrays([*keys, *plain, pa.array(top), pa.array(total), rows["groups"]], [*mine, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    schema = fields + "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    rows = blocks.where("doc").drop("doc")
    out = rows.groupBy("block").cogroup(back.groupBy("held_by")).applyInArrow(add, schema)
    return out.toDF(*kept, *new)
