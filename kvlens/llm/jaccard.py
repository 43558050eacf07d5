"""N-gram Jaccard join by parity sketches.

Each document is its set of distinct word shingles, as 64-bit hashes.  Every hash flips one bit of a sketch,
so the Hamming distance of two sketches is at most the symmetric difference of the sets.  For sets of a size
band that difference has a limit D; with the hashes dealt to B > D blocks, two linked sets differ in at most D
blocks.  A block is compared by the XOR of its hashes in a Spark aggregation, which also counts its bucket.

Put a set's buckets in order, those of at most HOT rows first: two linked sets share one of their first D + 1.
So a linked pair either meets in a small bucket, whose pairs are listed, or both sets have fewer than D + 1
small buckets; only such sets (few but members of large groups of near copies) are looked for in the others.

Equal sets are one class, whose smallest document stands for it.  Components come first from one pair of each
bucket, then from the pairs of small buckets and from large buckets' smallest documents, and at last from the
rows of a large bucket that are outside its largest component, compared with its other rows in blocks inside
tasks.  Pairs that meet are checked by size, by Hamming distance and last by the exact sets.

Defined cases: null, empty and blank texts have no shingles and no links; with fewer words than a shingle
the whole sequence is the one shingle; rows of one repeated id are one document whose rows' links are
joined; a row without id takes its class's smallest id (null if none); no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlens.llm.common import BROADCAST_IDS, Scratch, bounded, documents, fresh, keep_ids, map_rows, row_key, text_or_empty
from kvlens.llm.components import components

U = np.uint64
#: Rows of a large bucket compared at once, and the size up to which a bucket's pairs are listed by a join.
CHUNK, HOT = 1024, 8
#: Size bands grow by this factor at least; blocks for each that must be looked at; the bits of a key that say its band.
BAND, SPARE, BAND_BITS = 1.5, 1.25, 7


@dataclass(frozen=True)
class Rule:
    """Sets of shingles of ``words`` words are linked when denominator * intersection >= numerator * union."""

    words: int = 5
    numerator: int = 80
    denominator: int = 100

    def apart(self, total: int) -> int:
        """The largest symmetric difference of linked sets whose sizes sum to ``total``."""
        return (self.denominator - self.numerator) * total // (self.denominator + self.numerator)

    def partner(self, n: int) -> int:
        """The largest set that a set of n can be linked with."""
        return n * self.denominator // self.numerator

    def bands(self) -> list[int]:
        """Smallest size of each band."""
        lows, grow = [1], max(BAND, self.denominator / self.numerator)
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, int(lows[-1] * grow)))
        return lows


# -- hashing ------------------------------------------------------------------------------------------------

_RANDOM = np.random.default_rng(7)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=U)
_STEP = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _RANDOM.integers(0, 1 << 63, 64, dtype=U) * U(2) + U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.r_[U(1), np.full(size, step, U)], dtype=U) for step in (_STEP, _INVERSE)]
    return _powers


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, U)
    data = np.frombuffer(b" ".join(found), np.uint8)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    word = mix((sums[ends] - sums[starts]) * down[starts] + lengths.astype(U))
    size = min(words, len(found))
    total = np.full(len(found) - size + 1, U(size), U)
    for i in range(size):
        total += word[i : len(found) - size + 1 + i] * _PLACE[i]
    return np.unique(mix(total))


def sketch(hashes: np.ndarray) -> bytes:
    """Parity bits, a power of two of them and about four a hash; a longer sketch folds into a shorter one."""
    bits = 1 << max(6, min(17, int(4 * max(1, len(hashes)) - 1).bit_length()))
    odd = np.bincount((hashes & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(s: np.ndarray, size: int) -> np.ndarray:
    while len(s) > size:
        s = s[: len(s) // 2] ^ s[len(s) // 2 :]
    return s


def hamming(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())


def signatures(hashes: np.ndarray, rule: Rule, lows: list[int]) -> tuple[np.ndarray, list[int]]:
    """Bucket keys of a set, for its own band and, if a partner may lie there, the next; spare keys of even and odd bands.

    Of a band's keys all but the spare ones must be looked at.  Blocks without a hash come last in any order,
    so a set that has enough others leaves them out.
    """
    n, out, spare = len(hashes), [], [0, 0]
    own = int(np.searchsorted(lows, n, "right")) - 1
    for band in (own, own + 1):
        low, high = lows[band], lows[band + 1] - 1
        largest = min(rule.partner(n), high)
        if largest < low:
            continue
        need = rule.apart(n + largest) + 1
        if need == 1:
            continue  # only equal sets are linked
        most = rule.apart(2 * high) + 1
        blocks = max(int(SPARE * most) + 1, min(32, 8 * most))
        place = ((hashes >> U(20)) % U(blocks)).astype(np.int64)
        value = np.zeros(blocks, U)
        np.bitwise_xor.at(value, place, mix(hashes + U(band + 1)))
        block = np.unique(place)
        if len(block) < need:
            block = np.arange(blocks)
        keys = mix(value[block] + mix(block.astype(U) * _STEP + U(band * int(_PLACE[0]) & (1 << 64) - 1)))
        out.append(keys >> U(64 - 49) << U(BAND_BITS) | U(band))
        spare[band & 1] = len(block) - need
    return (np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)), spare


# -- stages -------------------------------------------------------------------------------------------------


def base_table(docs: DataFrame, rule: Rule, salt: int) -> DataFrame:
    """doc_id, n, class and check (digests of the set), sketch, keys (of its buckets), spare (keys of even and odd bands)."""
    lows = rule.bands()

    def run(ids: list, texts: list) -> dict:
        sets = [shingle_hashes(t, rule.words) for t in texts]
        keys, spare = zip(*(signatures(s, rule, lows) for s in sets), strict=True)
        offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        digest = lambda s, k: int(mix(s + U(k)).sum(dtype=U).view(np.int64)) if len(s) else 0
        return {
            "doc_id": ids, "n": [len(s) for s in sets], "class": [digest(s, 2 * salt) for s in sets], "check": [digest(s, 2 * salt + 1) for s in sets],
            "sketch": [sketch(s) for s in sets], "keys": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys))), "spare": list(spare),
        }

    return map_rows(docs, run, "doc_id long, n long, class long, check long, sketch binary, keys array<long>, spare array<int>", rows=256)


def signature_table(heads: DataFrame) -> DataFrame:
    """key, id, spare: one row for each block of each document."""
    rows = heads.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"), "spare")
    return rows.select("key", "id", F.element_at("spare", (F.col("key").bitwiseAND(1) + 1).cast("int")).alias("spare"))


def pass_sketch(pairs: DataFrame, base: DataFrame, rule: Rule) -> DataFrame:
    """Those (a, b) whose sizes and sketches allow a link."""

    def run(a: list, b: list, na: list, nb: list, sa: list, sb: list) -> dict:
        kept = [i for i in range(len(a)) if max(na[i], nb[i]) <= rule.partner(min(na[i], nb[i])) and hamming(sa[i], sb[i]) <= rule.apart(na[i] + nb[i])]
        return {"a": [a[i] for i in kept], "b": [b[i] for i in kept]}

    side = lambda x: base.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return map_rows(joined.select("a", "b", "na", "nb", "sa", "sb"), run, "a long, b long", rows=4096).distinct()


def ends(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ends")


def linked(pairs: DataFrame, docs: DataFrame, base: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Those (a, b) whose exact sets are linked; only rows of ``base`` and texts that are in pairs are moved."""
    sketches = scratch.save(keep_ids(base, ends(pairs, scratch), "doc_id", "left_semi"), "sketches")
    close = scratch.save(pass_sketch(pairs, sketches, rule), "close")
    ids = ends(close, scratch)

    def sets_of(ids: list, texts: list) -> dict:
        return {"doc_id": ids, "hashes": [shingle_hashes(t, rule.words).tobytes() for t in texts]}

    sets = scratch.save(map_rows(keep_ids(docs, ids, "doc_id", "left_semi"), sets_of, "doc_id long, hashes binary", rows=256), "sets", compression="none")

    def run(a: list, b: list, ha: list, hb: list) -> dict:
        kept = []
        for i in range(len(a)):
            x, y = np.frombuffer(ha[i], U), np.frombuffer(hb[i], U)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if rule.denominator * common >= rule.numerator * (len(x) + len(y) - common):
                kept.append(i)
        return {"a": [a[i] for i in kept], "b": [b[i] for i in kept]}

    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("hashes").alias(f"h{x}"))
    joined = close.join(side("a"), "a").join(side("b"), "b")
    found = scratch.save(map_rows(joined.select("a", "b", "ha", "hb"), run, "a long, b long", rows=1024).distinct(), "links")
    scratch.drop(sets, sketches, close, ids)
    return found


def few_rows(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its rows are counted few."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS // 2 else df


def still_open(members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of buckets that hold several components, with their component.  ``members``: key, id and more."""
    marked = members.drop("component").join(few_rows(labels), "id", "left").withColumn("component", F.coalesce("component", "id"))
    marked = scratch.save(marked, "marked")
    keys = marked.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    return scratch.save(marked.join(keys, "key", "left_semi"), "open")


def small_pairs(few: DataFrame) -> DataFrame:
    """All pairs of different components in buckets of at most HOT rows."""
    a = few.select("key", F.col("id").alias("a"), F.col("component").alias("ca"))
    b = few.select("key", F.col("id").alias("b"), F.col("component").alias("cb"))
    return a.join(b, "key").where("a < b AND ca <> cb").select("a", "b")


def exposed(members: DataFrame) -> DataFrame:
    """Those rows of large buckets whose set has more keys of large buckets in a band than it has to spare."""
    large = members.where(F.col("size") > HOT).withColumn("band", F.col("key").bitwiseAND((1 << BAND_BITS) - 1))
    short = large.groupBy("id", "band").agg(F.count(F.lit(1)).alias("n"), F.min("spare").alias("spare")).where("n > spare").select("id", "band")
    return large.join(short, ["id", "band"], "left_semi").drop("band")


def large_pairs(open_members: DataFrame, base: DataFrame, rule: Rule, scratch: Scratch, askers: DataFrame | None = None) -> DataFrame:
    """a, b, more: pairs of different components in large buckets that pass the sketch.

    Rows outside a bucket's largest component are compared with all others: both are dealt to chunks, and
    every two chunks meet in one group.  A row keeps its nearest row of each other component in a group, and
    ``more`` says that others passed.  With ``askers`` (id) only these rows are compared, and every pair is kept.
    """
    nearest = askers is None
    rows = open_members.select("key", "id", "component").withColumn("asks", F.lit(True))
    if askers is not None:
        rows = rows.drop("asks").join(few_rows(askers.withColumn("asks", F.lit(True))), "id", "left").withColumn("asks", F.col("asks").isNotNull())
    sizes = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking"))
    whole = sizes.groupBy("key").agg(F.sum("n").alias("rows"), F.sum("asking").alias("asking"), F.max(F.struct("n", "component", "asking")).alias("largest"))
    whole = whole.select("key", "rows", F.col("largest.component").alias("main"), (F.col("asking") - F.col("largest.asking")).alias("minor")).where("minor > 0")
    rows = scratch.save(rows.join(few_rows(scratch.save(whole, "whole")), "key"), "asked")
    sketches = keep_ids(base, scratch.save(rows.select(F.col("id").alias("doc_id")).distinct(), "ids"), "doc_id", "left_semi")
    many = rows.join(sketches.select(F.col("doc_id").alias("id"), "n", "sketch"), "id")
    chunks = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("id"), chunks(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), chunks(n) - 1)
    dealt = many.withColumn("at", F.explode(F.concat(
        F.when(F.col("asks") & (F.col("component") != F.col("main")), F.transform(every("rows"), lambda j: F.struct(own("minor").alias("i"), j.alias("j"), F.lit(True).alias("asks")))).otherwise(F.array()),
        F.transform(every("minor"), lambda i: F.struct(i.alias("i"), own("rows").alias("j"), F.lit(False).alias("asks"))),
    )))
    dealt = dealt.select("key", "at.i", "at.j", "at.asks", "id", "component", "n", "sketch")

    def compare(rows: list[tuple]) -> Iterator[tuple[int, int, bool]]:
        size = min(len(r[7]) for r in rows)
        words = np.stack([fold(np.frombuffer(r[7], np.uint8), size) for r in rows]).view(U)
        ids, comp, n = (np.array([r[k] for r in rows], np.int64) for k in (4, 5, 6))
        asks = np.array([r[3] for r in rows], bool)
        others = np.flatnonzero(~asks)
        for x in np.flatnonzero(asks):
            y = others[comp[others] != comp[x]]
            low, high = np.minimum(n[y], n[x]), np.maximum(n[y], n[x])
            y = y[high <= low * rule.denominator // rule.numerator]
            apart = np.bitwise_count(words[y] ^ words[x]).sum(1)
            near = apart <= (rule.denominator - rule.numerator) * (n[y] + n[x]) // (rule.denominator + rule.numerator)
            y, apart = y[near], apart[near]
            several = np.zeros(len(y), bool)
            if nearest and len(y):
                order = np.argsort(apart, kind="stable")
                _, first, times = np.unique(comp[y][order], return_index=True, return_counts=True)
                y, several = y[order][first], times > 1
            for z, more in zip(y, several, strict=True):
                yield (min(ids[x], ids[z]), max(ids[x], ids[z]), bool(more))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        found: list[tuple[int, int, bool]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    found += compare(group)
                    group = []
                group.append(row)
            if found:
                yield as_batch(found)
                found = []
        if group:
            found += compare(group)
        if found:
            yield as_batch(found)

    def as_batch(found: list) -> pa.RecordBatch:
        a, b, more = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(map(int, a)), pa.int64()), pa.array(list(map(int, b)), pa.int64()), pa.array(more, pa.bool_())], names=["a", "b", "more"])

    made = bounded(dealt).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long, more boolean")
    return made.groupBy("a", "b").agg(F.max("more").alias("more"))


def classes(docs: DataFrame, rule: Rule, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The base table without and with rows that have no set or id, and class, head, n (its rows) of each class; a digest that two sets share is drawn anew with another salt."""
    for salt in range(8):
        base = scratch.save(base_table(docs, rule, salt), "base")
        known = base.where("n > 0 AND doc_id IS NOT NULL")
        sums = base.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("rows"), F.min("check").alias("x"), F.max("check").alias("y"))
        heads = scratch.save(sums, "heads")
        if not heads.where("x <> y").limit(1).count():
            return known, base, heads.select("class", "head", "rows")
        scratch.drop(base)
    raise RuntimeError("class digests clash under eight salts; the corpus needs wider digests")


def join_documents(rows: DataFrame, scratch: Scratch, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    docs = rows.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    known, base, heads = classes(docs, rule, scratch)
    several = heads.where("rows > 1").select("class", "head")
    marked = known.join(few_rows(several), "class", "left").where("head IS NULL OR head = doc_id").drop("head")
    head_base = marked.select("doc_id", "n", "sketch")

    # Sums in the map tasks make any bucket one row a task.
    buckets = signature_table(marked).groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("size")).where("a < b")
    buckets = scratch.save(buckets, "buckets")
    links = linked(scratch.save(buckets.select("a", "b").distinct(), "pairs"), docs, head_base, rule, scratch)
    labels = components(links, scratch)

    def join_up(pairs: DataFrame) -> None:
        nonlocal labels
        more = linked(pairs, docs, head_base, rule, scratch)
        if more.limit(1).count():
            tree = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
            labels = components(tree.unionByName(more), scratch)

    # Buckets of three and more.
    wide = scratch.save(buckets.where("size > 2").select("key", "a", "size"), "wide")
    if wide.limit(1).count():
        members = scratch.save(signature_table(marked).join(few_rows(wide), "key"), "members")
        hot = exposed(members)
        open_members = still_open(members.where(F.col("size") <= HOT).unionByName(hot), labels, scratch)
        listed = small_pairs(open_members.where(F.col("size") <= HOT))
        to_least = open_members.where((F.col("size") > HOT) & (F.col("id") != F.col("a"))).select(F.least("id", "a").alias("a"), F.greatest("id", "a").alias("b"))
        join_up(scratch.save(listed.unionByName(to_least).distinct(), "pairs"))
        hot = open_members.where(F.col("size") > HOT)
        if hot.limit(1).count():
            open_hot = still_open(hot, labels, scratch)
            if open_hot.limit(1).count():
                near = scratch.save(large_pairs(open_hot, head_base, rule, scratch), "near")
                join_up(near.select("a", "b"))
                askers = scratch.save(near.where("more").select(F.explode(F.array("a", "b")).alias("id")).distinct(), "askers")
                if askers.limit(1).count():
                    rest = still_open(open_hot, labels, scratch)
                    join_up(scratch.save(large_pairs(rest, head_base, rule, scratch, askers).select("a", "b"), "rest"))

    labelled = heads.join(labels.select(F.col("id").alias("head"), "component"), "head", "left").select("class", F.coalesce("component", "head").alias("component"))
    out = base.select("doc_id", "n", "class").join(labelled, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(rows: DataFrame, scratch: Scratch, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``rows``, with all columns, whose document has the smallest id of its component.

    Of rows that share an id the least (by all columns in order) stays; rows without id are named by their text.
    """
    key = fresh(rows, "key")
    keyed = rows.withColumn(key, row_key(id_col, text_col))
    found = join_documents(keyed.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text")), scratch, rule)
    found = scratch.save(found.select("doc_id", "component_id"), "found")
    extra = scratch.save(found.where("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct(), "extra")
    repeated = scratch.save(found.groupBy(F.col("doc_id").alias(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "repeated")
    kept, n_repeated = keep_ids(keyed, extra, key, "left_anti"), repeated.count()
    if n_repeated:
        several = keep_ids(kept, repeated, key, "left_semi", n_repeated)
        least = several.groupBy(key).agg(F.min(F.struct(*rows.columns)).alias("row")).select(key, "row.*")
        kept = keep_ids(kept, repeated, key, "left_anti", n_repeated).unionByName(least)
    return kept.select(*rows.columns)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(documents(spark, sf_dir), Scratch(spark, "jaccard"), Rule(4, 85, 100))


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT f.doc_id, w.b FROM reached f JOIN ways w ON w.a = f.r)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT doc_id, min(r) AS component_id FROM reached GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""
