"""SimHash near-duplicates found with Golay-code fuzzy keys (operator 6).

The [23, 12] Golay code puts each 23-bit word within three bits of just one codeword.
The codewords within four bits of a word are one or six, and two words that differ in
two bits at most always share one of them. So a segment of a fingerprint gets up to six
keys that tolerate two errors.

*Fingerprints within two bits* (``linked``). A 64-bit fingerprint has three segments.
Two errors leave one segment whole (the pigeonhole), so each family of keys joins one
whole segment with the fuzzy keys of the next one; both errors may fall there. Keys are
counted before any join. A key of two fingerprints is a candidate pair already; a key
with a few makes its pairs; a key with more than ``PAIRED`` is not paired at all: its
fingerprints are linked through the fingerprints one bit away, which is exact, because
two fingerprints share such a neighbour just when they differ in two bits at most, and
which is small, because a neighbour has 65 such fingerprints at most.

*Texts of a given similarity* (``copies``). Copies of similarity 0.8 differ in far more
than two of 64 bits, so these are joined by shingles. With the shingles of every text in
one order, rare ones first, two sets of similarity 0.8 share one of each other's first
fifth (the prefix filter), which is exact in any order. A shingle of a few texts gives all
their pairs. Texts of a larger one meet its hub first; then those that no link joins yet
meet in blocks, each two of them. Pairs that their sizes, the shingle's places or parity
bits rule out are dropped, and the others are verified by the similarity of their sets.
Rows are told apart by their place in their file, so texts are not copied, and the joins
that need texts take only rows that a map of bits does not rule out.

Equal texts and equal fingerprints are grouped first, so no step pairs exact copies.
Joins are by merge: no table that grows with the documents is broadcast, which would be built by the driver, several at once.

Defined results: a null or empty text has no words and fingerprint zero, linked like any
other; fewer words than a shingle make one shingle; repeated rows are kept, each with its
component; a null id takes part, and its component is the smallest id that is not null
(null if there is none); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import Cuts, kind_of, lean, maybe_among, small_batches, told_apart, unused, without_rows
from gleaner.llm.components import components

#: Generator polynomial of the Golay code. (A fixed value.)
GENERATOR = 0b101011100011
#: First bit and width of the segments of a 64-bit fingerprint.
PARTS = ((0, 22), (22, 21), (43, 21))
#: Keys with so many fingerprints make all their pairs; larger ones go by neighbours.
PAIRED = 24

#: 64-bit words of the short parity bits of a text's shingles, and their columns. Long texts have longer ones too.
PARITY = 8
PARITIES = tuple(f"w{k}" for k in range(PARITY))
#: One text in so many orders the shingles. A shingle in so many texts of the sample is common; so many are listed at most.
SAMPLED, COMMON, MOST_COMMON = 32, 4, 1 << 20
#: A shingle of ``copies`` with so many texts makes all their pairs at once; a larger one goes by its hub first.
MET = 8
#: Texts of a block of a large shingle, about.
BLOCK = 256


def _remainder(x: int) -> int:
    for bit in range(22, 10, -1):
        if x >> bit & 1:
            x ^= GENERATOR << (bit - 11)
    return x


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the upper 12 bits, and per syndrome the error patterns of four bits at most.

    A syndrome has one pattern of three bits at most and, if that has three, five of four.
    A row is filled up with its first pattern.
    """
    single = [_remainder(1 << b) for b in range(23)]
    upper = np.zeros(1 << 12, np.int64)
    for b in range(12):
        upper[1 << b : 2 << b] = upper[: 1 << b] ^ single[b + 11]
    found: list[list[int]] = [[] for _ in range(1 << 11)]

    def grow(first: int, left: int, pattern: int, syndrome: int) -> None:
        found[syndrome].append(pattern)
        for b in range(first, 23 if left else first):
            grow(b + 1, left - 1, pattern | 1 << b, syndrome ^ single[b])

    grow(0, 4, 0, 0)
    rows = [sorted(x, key=lambda p: p.bit_count()) for x in found]
    return upper, np.array([x + x[:1] * (6 - len(x)) for x in rows], np.int64)


_tables: list[tuple[np.ndarray, np.ndarray]] = []


def fuzzy_keys(words: np.ndarray) -> np.ndarray:
    """n words of up to 23 bits -> (n, 6) indices of the codewords within four bits, with repeats."""
    if not _tables:
        _tables.append(golay_tables())
    upper, patterns = _tables[0]
    words = words.astype(np.int64)
    return (words[:, None] ^ patterns[upper[words >> 11] ^ (words & 0x7FF)]) >> 11


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], size: int) -> list[int]:
    """XXH64 with seed 42 of each run of ``size`` words; of all words where there are fewer."""
    if not words:
        return []
    whole = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(whole, 42)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    return [digest(whole[a:b], 42) for a, b in zip((ends - lengths)[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, size: int = 3) -> int:
    return majority(np.array(shingles(words_of(text), size), np.uint64))


def fingerprints(docs: DataFrame, size: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key and ``fp``, the fingerprint's 64 bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fp)], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(lean(run), f"`{key}` {kind_of(docs, key)}, fp long")


def _keyed(nodes: DataFrame) -> DataFrame:
    """(fp) -> (key, fp): per family a whole segment and one codeword near the next segment."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            part = [((fp >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in PARTS]
            for k in range(3):
                near = fuzzy_keys(part[(k + 1) % 3])
                first = np.append(np.ones((len(near), 1), bool), near[:, 1:] != near[:, :1], axis=1)
                keys = (k << 34) | (part[k][:, None] << 12) | near
                yield pa.record_batch([pa.array(keys[first]), pa.array(np.repeat(fp.view(np.int64), first.sum(1)))], names=["key", "fp"])

    return nodes.select("fp").mapInArrow(lean(run), "key long, fp long")


def linked(nodes: DataFrame, bits: int = 2) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) that join all fingerprints within two bits."""
    if not 0 <= bits <= 2:
        raise ValueError("these keys find up to two differing bits")
    keyed = _keyed(nodes)
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    twos = counts.where("n = 2").select("u", "v")
    many = keyed.join(counts.where("n > 2").select("key", "n").hint("merge"), "key")
    few = many.where(F.col("n") <= PAIRED)
    pairs = few.select("key", F.col("fp").alias("u")).join(few.select("key", F.col("fp").alias("v")).hint("merge"), "key").where("u < v").select("u", "v")
    hot = many.where(F.col("n") > PAIRED).select("fp").distinct()
    if bits == 2:
        flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    elif bits == 1:
        flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b))
    else:
        flips = F.array(F.lit(0).cast("long"))
    if bits == 1:  # neighbours of distance one are the links themselves
        around = hot.select(F.col("fp").alias("u"), F.explode(flips).alias("flip")).select("u", F.col("u").bitwiseXOR(F.col("flip")).alias("v"))
        close = around.join(hot.select(F.col("fp").alias("v")).hint("merge"), "v", "left_semi").select("u", "v")
    else:
        around = hot.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
        # a neighbour has 65 fingerprints at most, so this list is bounded
        met = around.groupBy("mid").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
        close = met.select(F.array_min("all").alias("u"), F.explode("all").alias("v")).where("u <> v")
    return twos.unionByName(pairs).where(near).unionByName(close).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, bits: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest key that links reach."""
    cuts = Cuts(docs.sparkSession, "simhash")
    rows = cuts.write(fingerprints(docs, size, text, key))
    nodes = cuts.write(rows.groupBy("fp").agg(F.min(key).alias("least")))
    roots = cuts.write(components(linked(nodes, bits), cuts))
    named = nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # a root's own row and its members' rows meet in a sum over links only, not over documents
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = named.select("fp", "root").join(least.hint("merge"), "root").select("fp", "component_id")
    return rows.join(of_fp.hint("merge"), "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- texts of a given similarity


def _once(docs: DataFrame, size: int, text: str) -> DataFrame:
    """(token, n) of the shingles of one text in ``SAMPLED``: in how many of these texts each is."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(np.array(shingles(words_of(t), size), np.uint64)) for t in batch.column(0).to_pylist()]
            token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    small_batches(docs.sparkSession)
    sample = docs.where(F.pmod(F.xxhash64(text), F.lit(SAMPLED)) == 0).select(text)
    return sample.mapInArrow(lean(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def common_shingles(docs: DataFrame, size: int, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample, sorted, and their counts. They only order shingles: any list gives the same links."""
    top = _once(docs, size, text).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "token").limit(MOST_COMMON).toArrow()
    token, n = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def prefix(tokens: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of distinct shingles, rare ones first: sets of this similarity share one of them."""
    listed, counts = common
    rank = np.zeros(len(tokens), np.int64)
    if len(listed) and len(tokens):
        at = np.minimum(np.searchsorted(listed, tokens), len(listed) - 1)
        rank = np.where(listed[at] == tokens, counts[at], 0)
    return tokens[np.lexsort((tokens, rank))][: len(tokens) - least_shared(similarity, len(tokens)) + 1]


def least_shared(similarity: float, n: int) -> int:
    return max(1, int(np.ceil(similarity * n - 1e-9)))


def parity(tokens: np.ndarray, words: int = PARITY) -> np.ndarray:
    """So many 64-bit words, in which each shingle flips one bit: two sets differ in as many shingles as bits at least.

    Halves of a longer one, a power of two apart, combine to a shorter one.
    """
    bits = np.bincount((tokens % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def parity_words(n: int) -> int:
    """A power of two with a bit for each of ``n`` shingles at least."""
    return max(PARITY, 1 << max(0, (n + 63) // 64 - 1).bit_length())


def described(docs: DataFrame, common, text: str, fine: int = 3, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(same, least, text) -> ``same``, ``least``, ``fp``, and of the text's shingles the number ``n``, the ``prefix``, the short parity words and, if that is longer, ``parity``."""
    small_batches(docs.sparkSession)
    docs = docs.select("same", "least", text)

    def run(batches):
        for batch in batches:
            fp, n, first, short, long = [], [], [], [], []
            for t in batch.column(2).to_pylist():
                words = words_of(t)
                fp.append(majority(np.array(shingles(words, fine), np.uint64)))
                tokens = np.unique(np.array(shingles(words, size), np.uint64))
                n.append(len(tokens))
                first.append(prefix(tokens, common.value, similarity).view(np.int64))
                bits = parity(tokens, parity_words(len(tokens)))
                long.append(bits if len(bits) > PARITY else bits[:0])
                short.append(np.bitwise_xor.reduce(bits.reshape(-1, PARITY), axis=0))
            w = np.array(short, np.int64).reshape(-1, PARITY)
            columns = [batch.column(0), batch.column(1), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int64()), *(pa.array(w[:, k].copy()) for k in range(PARITY)), pa.array(first, pa.list_(pa.int64())), pa.array(long, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["same", "least", "fp", "n", *PARITIES, "prefix", "parity"])

    shape = T.StructType([docs.schema["same"], docs.schema["least"]])
    for name in ("fp", "n", *PARITIES):
        shape.add(name, "long")
    for name in ("prefix", "parity"):
        shape.add(name, T.ArrayType(T.LongType()))
    return docs.mapInArrow(lean(run), shape)


def _shared(nodes: DataFrame, cuts: Cuts) -> DataFrame:
    """(node, n, prefix) -> a row per shingle of a prefix that several have: token, many, node, n, place, prev, first.

    ``place`` counts from 0, ``prev`` is the shingle before it that is in this table too.
    """
    keyed = nodes.select("node", "n", F.posexplode("prefix").alias("place", "token")).select("token", "node", (F.shiftleft("n", 32) + F.col("place")).alias("at"))
    counts = cuts.write(keyed.groupBy("token").agg(F.count("*").alias("many")).where("many > 1"))
    rows = keyed.join(counts.hint("merge"), "token").select("token", "many", "node", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("place"))
    # a text's prefix at most is one part of this window
    before = F.lag("token").over(Window.partitionBy("node").orderBy("place"))
    shared = cuts.write(rows.withColumn("prev", F.coalesce(before, F.lit(0).cast("long"))).withColumn("first", before.isNull()))
    cuts.drop(counts)
    return shared


def _meet(cells: DataFrame, similarity: float) -> DataFrame:
    """(token, a, b, side, node, n, place, prev, first, root) -> pairs (u, v) of ``node`` in a cell (token, a, b).

    Rows of one root are not paired, nor rows of one side if a and b differ. What two texts
    share from this shingle on must suffice; where both have one shingle before it, that
    shingle's cell has the pair.
    """

    def run(batches):
        held = None
        names = ("token", "a", "b", "side", "node", "n", "place", "prev", "first", "root")
        for batch in batches:
            x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if held is not None:
                x = {c: np.concatenate([held[c], x[c]]) for c in names}
            fresh = 0 if held is None else len(held["token"])
            size = len(x["token"])
            last = size
            found = [np.zeros(0, np.int64)]
            for d in range(1, size):
                low, high = slice(0, size - d), slice(d, size)
                together = (x["token"][low] == x["token"][high]) & (x["a"][low] == x["a"][high]) & (x["b"][low] == x["b"][high])
                if not together.any():
                    break
                i = np.flatnonzero(together)
                i = i[i + d >= fresh]
                j = i + d
                need = np.ceil(similarity / (1 + similarity) * (x["n"][i] + x["n"][j]) - 1e-9)
                rest = np.minimum(x["n"][i] - x["place"][i], x["n"][j] - x["place"][j])
                ok = (rest >= need) & (x["root"][i] != x["root"][j]) & ((x["prev"][i] != x["prev"][j]) | x["first"][i] | x["first"][j])
                ok &= (x["a"][i] == x["b"][i]) | (x["side"][i] != x["side"][j])
                u, v = x["node"][i[ok]], x["node"][j[ok]]
                found.append(np.stack([np.maximum(u, v), np.minimum(u, v)], 1).ravel())
            pairs = np.unique(np.concatenate(found).reshape(-1, 2), axis=0)
            if size:
                differs = (x["token"] != x["token"][-1]) | (x["a"] != x["a"][-1]) | (x["b"] != x["b"][-1])
                last = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
                held = {c: x[c][last:] for c in names}
            for at in range(0, len(pairs), 1 << 16):
                part = pairs[at : at + (1 << 16)]
                yield pa.record_batch([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], names=["u", "v"])

    cells = cells.select("token", F.col("a").cast("long"), F.col("b").cast("long"), F.col("side").cast("long"), "node", "n", "place", "prev", "first", "root")
    return cells.repartition("token", "a", "b").sortWithinPartitions("token", "a", "b").mapInArrow(lean(run), "u long, v long").distinct()


def _near(pairs: DataFrame, nodes: DataFrame, similarity: float, cuts: Cuts) -> DataFrame:
    """The pairs whose sizes and parities allow the similarity."""
    end = lambda c: nodes.select(F.col("node").alias(c), F.struct("n", *PARITIES).alias(f"{c}_"))
    got = pairs.join(end("u").hint("merge"), "u").join(end("v").hint("merge"), "v")
    differ = sum((F.bit_count(F.col(f"u_.{w}").bitwiseXOR(F.col(f"v_.{w}"))) for w in PARITIES), F.lit(0))
    sizes = F.least("u_.n", "v_.n") >= similarity * F.greatest("u_.n", "v_.n") - F.lit(1e-6)
    most = (1 - similarity) / (1 + similarity) * (F.col("u_.n") + F.col("v_.n")) + F.lit(1e-6)
    left = cuts.write(got.where(sizes & (differ <= most)).select("u", "v", most.alias("most")))
    # long texts have parities of their own length; the longer one is folded to the shorter one
    full = lambda c: nodes.where(F.size("parity") > 0).select(F.col("node").alias(c), F.col("parity").alias(f"{c}_"))
    both = left.join(full("u").hint("merge"), "u", "left").join(full("v").hint("merge"), "v", "left")
    wide, slim = F.size("u_") >= F.size("v_"), F.least(F.size("u_"), F.size("v_"))
    both = both.select("u", "v", "most", F.when(wide, F.col("u_")).otherwise(F.col("v_")).alias("wide"), F.when(wide, F.col("v_")).otherwise(F.col("u_")).alias("slim"), slim.alias("k"))

    def odd(j):
        turns = F.sequence(j, F.size("wide") - 1, F.col("k"))
        return F.bit_count(F.aggregate(turns, F.get("slim", j), lambda acc, i: acc.bitwiseXOR(F.get("wide", i))))

    counted = F.aggregate(F.sequence(F.lit(0), F.col("k") - 1), F.lit(0), lambda acc, j: acc + odd(j))
    return both.where(F.col("wide").isNull() | F.col("slim").isNull() | (counted <= F.col("most"))).select("u", "v")


def _first_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """All pairs of shingles that up to ``MET`` texts share; of others the pairs with the shingle's hub."""
    few = shared.where(F.col("many") <= MET).select("*", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), F.col("node").alias("root"))
    large = shared.where(F.col("many") > MET)
    central = large.groupBy("node").agg(F.count("*").alias("meets"))
    hubs = large.join(central.hint("merge"), "node").groupBy("token").agg(F.max_by("node", F.struct("meets", "node")).alias("hub"))
    rays = large.join(hubs.hint("merge"), "token").where("node <> hub").select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v"))
    return _meet(few, similarity).unionByName(rays).distinct()


def _other_pairs(shared: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """All pairs of shingles that more than ``MET`` texts share, but of texts that links join already.

    A shingle's texts are cut into blocks, and every two blocks meet in a cell of their own.
    """
    large = shared.where(F.col("many") > MET).join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # the size of the largest partner that what follows the shingle suffices for
    reach = (F.col("n") - F.col("place")) * F.lit((1 + similarity) / similarity) - F.col("n") + F.lit(1e-6)
    large = large.withColumn("reach", reach).where(F.col("reach") >= similarity * F.col("n") - F.lit(1e-6))
    whole = large.groupBy("token").agg(F.count("*").alias("left"), F.min("n").alias("least"), F.max("reach").alias("most"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    open_ = large.join(whole.hint("merge"), "token").where((F.col("reach") >= F.col("least") - F.lit(1e-6)) & (F.col("n") <= F.col("most") + F.lit(1e-6)))
    blocks = F.ceil(F.col("left") / F.lit(BLOCK)).cast("int")
    open_ = open_.withColumn("side", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return _meet(open_.withColumn("a", F.least("side", "other")).withColumn("b", F.greatest("side", "other")), similarity)


def _sets(docs: DataFrame, size: int, text: str) -> DataFrame:
    """(node, text) -> (node, set): the distinct shingle hashes, sorted."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(np.array(shingles(words_of(t), size), np.uint64)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    return docs.select("node", text).mapInArrow(lean(run), "node long, set binary")


def _alike(batches, similarity: float):
    """(u, v, set of u, set of v) -> the pairs (u, v) whose sets are similar enough."""
    for batch in batches:
        ok = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            short, long = sorted((len(x), len(y)))
            common = len(np.intersect1d(x, y, assume_unique=True)) if short and short >= similarity * long else 0
            ok.append(common > 0 and common >= similarity * (len(x) + len(y) - common))
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))


ROW = "copies_row"


def copies(docs: DataFrame, size: int = 5, similarity: float = 0.8, bits: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key and ``component_id``, the smallest key that links reach.

    Texts are linked if the sets of their ``size``-word shingles have at least this
    similarity, or if their fingerprints differ in ``bits`` bits at most; equal texts are one
    node. All such links are found, and none is made that does not hold.
    """
    cuts = Cuts(docs.sparkSession, "copies")
    (row,) = unused(docs.select(key, text), ROW)
    return _grouped(told_apart(docs, row, cuts), cuts, row, size, similarity, bits, text, key).select(F.col("key").alias(key), "component_id")


def _grouped(docs: DataFrame, cuts: Cuts, row: str, size: int = 5, similarity: float = 0.8, bits: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows that ``row`` tells apart -> per row: ``key``, ``row``, ``bare`` (no key and no words), ``component_id`` and ``first``, the row that stands for its group.

    The first row is one with the smallest key that is not null, if there is one.
    """
    spark = docs.sparkSession
    bare = F.col(key).isNull() & ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(row).alias("row"), bare.alias("bare"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("same"))
    order = F.struct(F.col("key").isNull().alias("keyless"), F.col("key").alias("key"), F.col("row").alias("row"))
    rows = cuts.write(docs.select("key", "row", "bare", "same"))
    # a text is described once; of equal ones, all but one are left out
    least = rows.groupBy("same").agg(F.min(order).alias("least"), F.count("*").alias("many")).where("many > 1")
    again = cuts.write(rows.join(least.hint("merge"), "same").where(F.col("row") != F.col("least.row")).select("row"))
    common = spark.sparkContext.broadcast(common_shingles(docs, size, "text"))
    once = without_rows(docs, "row", again).withColumn("least", order)
    nodes = cuts.write(described(once, common, "text", size=size, similarity=similarity).withColumn("node", F.monotonically_increasing_id()))
    shared = _shared(nodes, cuts)
    whole, nodes = nodes, cuts.write(nodes.drop("prefix"))
    cuts.drop(whole)
    # fingerprints that links join: a star of the nodes that have them
    fps = nodes.select("fp").distinct()
    roots = components(linked(fps, bits), cuts)
    group = nodes.select("node", "fp").join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    stars = group.join(group.groupBy("root").agg(F.min("node").alias("v")).hint("merge"), "root").select(F.col("node").alias("u"), "v").where("u <> v")

    def alike(pairs: DataFrame) -> DataFrame:
        pairs = cuts.write(_near(pairs, nodes, similarity, cuts))
        ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        # one text of each node that a pair names
        owners = cuts.write(nodes.join(ends.hint("merge"), "node").select(F.col("least.row").alias("row"), "node"))
        sets = cuts.write(_sets(maybe_among(docs.select("row", "text"), "row", owners).join(owners.hint("merge"), "row"), size, "text"))
        first = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("x")).hint("merge"), "u")
        both = first.join(sets.select(F.col("node").alias("v"), F.col("set").alias("y")).hint("merge"), "v").select("u", "v", "x", "y")
        found = cuts.write(both.mapInArrow(lean(lambda batches: _alike(batches, similarity)), "u long, v long"))
        cuts.drop(sets)
        return found

    first = cuts.write(components(alike(_first_pairs(shared, similarity)).unionByName(stars), cuts))
    more = alike(_other_pairs(shared, first, similarity))
    cuts.drop(shared)
    joined = cuts.write(components(more.unionByName(first.select(F.col("node").alias("u"), F.col("root").alias("v"))), cuts))
    belongs = nodes.select("node", "same", "least").join(joined.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    chosen = belongs.groupBy("root").agg(F.min("least").alias("first"))
    of = belongs.select("same", "root").join(chosen.hint("merge"), "root").select("same", F.col("first.key").alias("component_id"), F.col("first.row").alias("first"))
    return rows.join(of.hint("merge"), "same").select("key", "row", "bare", "component_id", "first")


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """``docs`` with one document of each group of copies, one with the smallest key that is not null.

    Rows are told apart by their places, not their keys: differing texts under one key, or
    under null, are documents of their own, and equal ones are copies. A row that has neither
    key nor words stays: nothing tells what it would be a copy of.
    """
    cuts = Cuts(docs.sparkSession, "kept")
    (own,) = unused(docs, ROW)
    told = told_apart(docs, own, cuts)
    gone = _grouped(told, cuts, own, text=text, key=key, **more).where((F.col("row") != F.col("first")) & ~F.col("bare"))
    return without_rows(told, own, cuts.write(gone.select(F.col("row").alias(own)))).drop(own)
