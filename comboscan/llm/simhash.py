"""SimHash fingerprints and near-duplicate groups by pigeonhole blocks.

A 64-bit fingerprint is cut into five blocks. Two that differ in at most two bits agree on at least three whole blocks, so
an equi-join on (which three, their 38 or 39 bits) meets every such pair; keys that long keep chance meetings rare in tables of
billions. Fingerprints that meet are told apart by their other 25 or 26 bits: each is listed under itself and under
each one-bit change of those. Two at a distance of two share the change halfway between them, a list holds 27 at most, and the
links from its least member are verified by Hamming distance. So crowded keys cost a constant for each member, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import among, connected_components, fresh, materialize, scratch, ship_package

SEED = 42
#: Bits in which linked fingerprints may differ; one-bit changes on either side reach exactly these.
LIMIT = 2
WIDTHS = (13, 13, 13, 13, 12)
#: Bit numbers of each block, and the blocks that are joined on together.
BLOCKS = [tuple(range(sum(WIDTHS[:i]), sum(WIDTHS[: i + 1]))) for i in range(len(WIDTHS))]
JOINED = list(combinations(range(len(WIDTHS)), len(WIDTHS) - LIMIT))


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lowered, cut at ASCII white space. Null counts as empty."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(w: list[bytes], size: int) -> list[bytes]:
    """Word shingles with repeats; a shorter text is one shingle, an empty text none."""
    if not w:
        return []
    if len(w) <= size:
        return [b" ".join(w)]
    if size == 1:
        return w
    if size == 3:
        return [a + b" " + b + b" " + c for a, b, c in zip(w, w[1:], w[2:])]
    return [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)]


def majority(h: np.ndarray) -> int:
    """The 64 bits set in over half of the hashes; zero for none."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):  # long texts in bounded steps
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, size: int = 3, lanes: int = 1, distinct: bool = False) -> list[int]:
    """Lanes of a text's fingerprint; lane i hashes shingles by XXH64 with seed 42 + i."""
    s = shingles(words(text), size)
    if distinct:
        s = list(set(s))
    digest = xxhash.xxh64_intdigest
    return [majority(np.fromiter((digest(x, SEED + i) for x in s), dtype="<u8", count=len(s))) for i in range(lanes)]


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, lanes: int = 1, distinct: bool = False, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and f0..: one signed 64-bit column for each lane."""
    ship_package(docs.sparkSession)
    names = [f"f{i}" for i in range(lanes)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = np.array([fingerprint(t, size, lanes, distinct) for t in pdf.pop("_text")], dtype="<u8").reshape(-1, lanes).view("<i8")
            for i, c in enumerate(names):
                pdf[c] = f[:, i]
            yield pdf

    # carried columns travel as text: pandas would turn integers beside a null into doubles
    src = docs.select(*[F.col(c).cast("string").alias(c) for c in carry], F.col(text).alias("_text"))
    out = src.mapInPandas(run, ", ".join([f"`{c}` string" for c in carry] + [f"{c} long" for c in names]))
    return out.select(*[F.col(c).cast(docs.schema[c].dataType).alias(c) for c in carry], *names)


def _signed(bits) -> int:
    """The bits as a signed 64-bit mask."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def near_links(nodes: DataFrame, f: str = "f") -> DataFrame:
    """(a, b) links between distinct fingerprints (column ``f``, long) that differ in at most two bits.

    The links connect just what all such pairs connect: every fingerprint is linked to the least of each list it shares
    with others, and each pair within two bits shares a list. Repeats of a fingerprint count once; null ones are not linked.
    """
    base = nodes.select(F.col(f).alias("f")).where("f is not null").distinct()
    masks = [_signed(b for i in part for b in BLOCKS[i]) for part in JOINED]
    free = [[0, *[_signed([b]) for i in range(len(WIDTHS)) if i not in part for b in BLOCKS[i]]] for part in JOINED]
    keyed = base.select("f", F.posexplode(F.array(*[F.col("f").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("part", "key"))
    met = keyed.join(keyed.groupBy("part", "key").count().where("count > 1").select("part", "key"), ["part", "key"])
    changes = F.get(F.array(*[F.array(*[F.lit(m).cast("long") for m in part]) for part in free]), F.col("part"))
    listed = met.select("f", "part", F.explode(F.transform(changes, lambda m: F.col("f").bitwiseXOR(m))).alias("change"))
    least = listed.withColumn("a", F.min("f").over(Window.partitionBy("part", "change")))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("f"))) <= LIMIT
    return least.where((F.col("a") < F.col("f")) & near).select("a", F.col("f").alias("b")).distinct()


def components(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: smallest doc_id reachable by links of at most two differing bits.

    One fingerprint is one node, however many documents carry it, so copies add no links. Null and empty texts have fingerprint
    zero, linked like any other. Null ids belong to their component but do not name it (null only if all of it is).
    Repeated rows are all returned; an empty table gives no rows; other columns are not read.
    """
    marks = materialize(fingerprints(docs, size=size), "fingerprints")
    nodes = materialize(marks.groupBy(F.col("f0").alias("node")).agg(F.min("doc_id").alias("least")), "nodes")
    roots = materialize(connected_components(near_links(nodes, "node"), "a", "b"), "roots")
    linked = nodes.join(roots, "node")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("low")), "root").select("node", "low")
    # only linked fingerprints need their root's name; the rest are named by their own documents
    name = nodes.join(named, "node", "left").select("node", F.coalesce("low", "least").alias("component_id"))
    out = marks.join(name, marks["f0"] == name["node"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


#: Min-wise fingerprints of the shingles: a pair of similarity s has all ROWS minima of one of BANDS bands alike with probability
#: 1 - (1 - s ** ROWS) ** BANDS: 0.9993 at 0.8, 0.31 at 0.5, 0.02 at 0.3, wherever and however its texts differ.
BANDS, ROWS = 24, 6
_FLIP, _STEP = (np.array([[xxhash.xxh32_intdigest(f"{k}{i}", SEED) | odd] for i in range(BANDS * ROWS)], dtype="<u4") for k, odd in (("flip", 0), ("step", 1)))
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: One bit of each minimum, in three longs, and in how many a pair may differ before its texts are not looked at: at a similarity of 0.8
#: a tenth of 144 differ, and more than 36 in one case of some 1,000,000.
SKETCH, APART = 3, 36
#: Members and text bytes that a chunk of a crowded bucket aims at; two chunks are one task's work.
TILE, CHUNK_BYTES = 2048, 16_000_000


def _key(text: str):
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def bands(text: str | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit key for each band of min-wise fingerprints of the set of word shingles, and the sketch of their last bits."""
    s = set(shingles(words(text), size))
    h = np.fromiter((xxhash.xxh32_intdigest(x, SEED) for x in s), dtype="<u4", count=len(s))
    low = np.full(BANDS * ROWS, ~np.uint32(0))
    for at in range(0, len(h), 4096):  # long texts in bounded steps
        low = np.minimum(low, ((h[at : at + 4096] ^ _FLIP) * _STEP).min(axis=1))
    key = np.arange(BANDS, dtype="<u8")
    for minima in low.reshape(BANDS, ROWS).T:
        key = (key ^ minima) * _MIX
        key ^= key >> np.uint64(32)
    bits = np.zeros(64 * SKETCH, np.uint8)
    bits[: len(low)] = low & 1
    return key.view("<i8"), np.packbits(bits, bitorder="little").view("<i8")


def _marks(texts: DataFrame, size: int) -> DataFrame:
    """node, n_bytes, the fingerprint of the distinct words, the band keys and the sketch of (node, _text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            t = pdf.pop("_text")
            pdf["f"] = np.array([fingerprint(x, 1, 1, True)[0] for x in t], dtype="<u8").view("<i8")
            pdf["bands"], pdf["sketch"] = zip(*[bands(x, size) for x in t]) if len(t) else ([], [])
            yield pdf

    src = texts.select("node", F.octet_length("_text").cast("long").alias("n_bytes"), "_text")
    return src.mapInPandas(run, "node long, n_bytes long, f long, bands array<long>, sketch array<long>")


def _true_forest(texts: list[str], group: np.ndarray, left: int, size: int, tenths: int) -> list[tuple[int, int]]:
    """Verified pairs that join all members of different groups that any verified pair joins; of a tile of two chunks
    (left > 0) only pairs across them count. One row is counted against all others at once."""
    number: dict[bytes, int] = {}
    sets = [np.array([number.setdefault(x, len(number)) for x in set(shingles(words(t), size))], dtype=np.int64) for t in texts]
    n = len(sets)
    count = np.array([len(x) for x in sets], dtype=np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), count)
    mark, group, out = np.zeros(len(number), bool), group.copy(), []
    for i in range(left or n - 1):
        j = np.arange(left or i + 1, n)
        j = j[group[j] != group[i]]
        if not len(j):
            continue
        mark[sets[i]] = True
        both = np.bincount(owner[mark[flat]], minlength=n)[j]
        mark[sets[i]] = False
        for k in j[10 * both >= tenths * (count[i] + count[j] - both)]:
            if group[k] != group[i]:
                out.append((i, int(k)))
                group[group == group[k]] = group[i]
    return out


def _verified(links: DataFrame, texts: DataFrame, size: int, tenths: int) -> DataFrame:
    """The (a, b) whose texts' shingle sets are similar enough; rows with the same a tend to come together."""
    right = links.join(texts.select(F.col("node").alias("b"), F.col("_text").alias("t")), "b")
    both = right.join(texts.select(F.col("node").alias("a"), F.col("_text").alias("s")), "a")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, x = None, set()
        for pdf in batches:
            good = []
            for s, t in zip(pdf["s"], pdf["t"]):
                if s != last:
                    last, x = s, set(shingles(words(s), size))
                y = set(shingles(words(t), size))
                n = len(x & y)
                good.append(10 * n >= tenths * (len(x) + len(y) - n))
            yield pdf.loc[good, ["a", "b"]]

    return both.select("a", "b", "s", "t").mapInPandas(run, "a long, b long")


def _tiled(members: DataFrame, tile: int) -> DataFrame:
    """Members (key, node, n_bytes, ..) once for each pair of chunks (lo, hi) of their bucket that theirs is in; chunks are
    of bounded size, and every two members of a bucket meet in one pair of chunks."""
    size = members.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.sum("n_bytes").alias("bytes"))
    chunks = F.greatest(F.ceil(F.col("count") / F.lit(tile)), F.ceil(F.col("bytes") / F.lit(CHUNK_BYTES)), F.lit(1)).cast("long")
    many = members.join(size.select("key", chunks.alias("chunks")), "key").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return many.withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")}).drop("n_bytes", "chunks", "other")


def _open_buckets(buckets: DataFrame, links: DataFrame, texts: DataFrame, sketches: DataFrame, size: int, tenths: int, tile: int) -> DataFrame:
    """Verified links of the buckets whose members ``links`` leave in several groups.

    Each bucket's pairs with its hub have been tried. Where the other members are not of one group, every pair of different groups is
    tried, in tiles of bounded size, so no link is lost by what was tried first: by sketch, then by text, which only members with a
    near sketch in another group need. Of buckets with the same members one is read.
    """
    roots = materialize(connected_components(links, "a", "b"), "bucket_roots")
    inside = buckets.where("count > 2 and node <> hub").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    inside = materialize(inside.select("key", "node", "n_bytes", "root"), "inside")
    split = inside.groupBy("key").agg(
        F.count(F.lit(1)).alias("count"), F.min("root").alias("least"), F.max("root").alias("most"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same")
    ).where("least < most")
    split = materialize(split.groupBy("count", "same").agg(F.min("key").alias("key")).select("key"), "split")
    members = inside.join(split, "key")

    def arranged(pdf: pd.DataFrame) -> tuple[pd.DataFrame, int]:
        """Rows by chunk, and how many are of the first of two chunks; -1 where nothing is to be compared."""
        pdf = pdf.sort_values(["chunk", "node"], kind="stable")
        left = int((pdf["chunk"] == pdf["lo"]).sum()) if pdf["lo"].iloc[0] != pdf["hi"].iloc[0] else 0
        return pdf, -1 if left == len(pdf) or pdf["root"].nunique() == 1 else left

    def sift(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, left = arranged(pdf)
        n, live = len(pdf), np.zeros(len(pdf), bool)
        if left >= 0:
            bits, group = np.stack(pdf["sketch"].to_numpy()).view("<u8"), pdf["root"].to_numpy()
            for i in range(left or n - 1):
                j = slice(left or i + 1, n)
                near = (np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1) <= APART) & (group[j] != group[i])
                live[j] |= near
                live[i] |= near.any()
        return pdf.loc[live, ["key", "node"]]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, left = arranged(pdf)
        if left < 0:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        pairs = np.array(_true_forest(pdf["_text"].tolist(), pdf["root"].to_numpy(), left, size, tenths), dtype=int).reshape(-1, 2)
        ids = pdf["node"].to_numpy()
        return pd.DataFrame({"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]]})

    sketched = _tiled(members, tile).join(sketches, "node").select("key", "node", "root", "chunk", "lo", "hi", "sketch")
    # little data but much work: one partition for all of it would be one task
    spread = int(sketched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketched = sketched.repartition(spread, "key", "lo", "hi")
    live = materialize(sketched.groupBy("key", "lo", "hi").applyInPandas(sift, "key long, node long"), "live")
    # written, as it is read for the texts to move and for where they go
    tiles = materialize(_tiled(members.join(live.distinct(), ["key", "node"]), tile), "tiles")
    full = tiles.join(among(texts, "node", tiles.select("node")), "node").select("key", "node", "root", "chunk", "lo", "hi", "_text")
    return full.repartition(spread, "key", "lo", "hi").groupBy("key", "lo", "hi").applyInPandas(compare, "a long, b long")


def _numbered(docs: DataFrame, text: str) -> DataFrame:
    """(node, key, _text): distinct texts, one row of each, numbered as the rows are written; null counts as empty. No text is shuffled."""
    rows = docs.select(F.monotonically_increasing_id().alias("node"), _key(text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = materialize(rows, "texts")
    return among(rows, "node", rows.groupBy("key").agg(F.min("node").alias("node")).select("node"))


def similar_links(numbered: DataFrame, words_each: int = 5, tenths: int = 8, tile: int = TILE) -> DataFrame:
    """(a, b) verified links that connect the texts (node, _text) just as all pairs with a Jaccard similarity of at least
    tenths / 10 do, as far as those are met.

    A pair is met if it shares a band of min-wise fingerprints of its shingles, which a pair at 0.8 misses in one case of some
    1,500 whatever the edit, or if SimHash fingerprints of its distinct words differ in at most two bits. Links that the min-wise
    sketches don't rule out are verified on the shingles themselves, first those of each fingerprint's or bucket's least member, then, where a bucket's members are still in
    several groups, all pairs between groups. One path for buckets of every size; only links that join groups are kept.
    """
    marks = materialize(_marks(numbered, words_each), "marks")
    prints = marks.groupBy("f").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("count"))
    same = marks.select("node", "f").join(prints.where("count > 1"), "f").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    hubs = prints.select("f", "hub")
    close = near_links(hubs).join(hubs.select(F.col("f").alias("a"), F.col("hub").alias("u")), "a").join(hubs.select(F.col("f").alias("b"), F.col("hub").alias("v")), "b")
    keyed = marks.select("node", "n_bytes", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("node").alias("hub")).where("count > 1")
    buckets = materialize(keyed.join(shared, "key"), "buckets")
    stars = buckets.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    links = stars.unionByName(same).unionByName(close.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))).distinct()
    sketches = marks.select("node", "sketch")
    for end in "ab":
        links = links.join(sketches.select(F.col("node").alias(end), F.col("sketch").alias(f"s{end}")), end)
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    links = materialize(links.where(apart <= APART).select("a", "b"), "candidates")
    ends = materialize(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct(), "ends")
    # only texts that are in a candidate pair are moved; a member with a near sketch in its bucket may be in none
    texts = numbered.select("node", "_text")
    met = materialize(among(texts, "node", ends), "met")
    good = materialize(_verified(links, met, words_each, tenths), "verified")
    return good.unionByName(_open_buckets(buckets, good, texts, sketches, words_each, tenths, tile)).distinct()


def similar_pairs(docs: DataFrame, words_each: int = 5, tenths: int = 8, text: str = "text", tile: int = TILE) -> DataFrame:
    """(a, b) text keys of ``similar_links`` over the distinct texts of ``docs``; null counts as empty, an empty table gives none."""
    ship_package(docs.sparkSession)
    numbered = _numbered(docs, text)
    links, keys = similar_links(numbered, words_each, tenths, tile), numbered.select("node", "key")
    left = links.join(keys.select(F.col("node").alias("a"), F.col("key").alias("ka")), "a")
    both = left.join(keys.select(F.col("node").alias("b"), F.col("key").alias("kb")), "b")
    return both.select(F.col("ka").alias("a"), F.col("kb").alias("b"))


def deduplicate(docs: DataFrame, words_each: int = 5, tenths: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of copies and near copies (all columns): the one with the smallest id, null ids last.

    Equal texts form one group, null and empty texts among them; groups grow over verified similar pairs. Rows that are equal
    in id and text are one document. An empty table gives no rows. Very long texts are compared whole.
    """
    spark = docs.sparkSession
    ship_package(spark)
    row, key = fresh("_row", docs.columns), fresh("_key", docs.columns)
    void = [c for c, kind in docs.dtypes if kind == "void"]  # a Parquet table can't hold those
    rows = materialize(docs.withColumns({row: F.monotonically_increasing_id(), key: _key(text), **{c: F.lit(None).cast("string") for c in void}}), "rows")
    with scratch(spark) as made:
        ids = rows.select(F.col(key).alias("key"), F.col(doc_id).alias("id"), F.col(row).alias("node"))
        # a text's row is its first one of the smallest id; from here on a text is that row's number
        first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "node")).alias("first")
        nodes = materialize(ids.groupBy("key").agg(first).select("key", "first.no", "first.id", "first.node"), "nodes")
        numbered = among(rows.select(F.col(row).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("_text")), "node", nodes.select("node"))
        roots = materialize(connected_components(similar_links(numbered, words_each, tenths), "a", "b"), "roots")
        # linked texts choose one of each group; the others go but for it
        linked = nodes.join(roots, "node")
        best = linked.groupBy("root").agg(F.min(F.struct("no", "id", "key", "node")).alias("best"))
        gone = materialize(linked.join(best, "root").where(F.col("node") != F.col("best")["node"]).select("node"), "gone")
        out = among(rows, row, nodes.select("node").join(gone, "node", "left_anti"))
        made.pop()  # the bits of the rows that stay
    return out.withColumns({c: F.lit(None) for c in void}).drop(row, key)
