"""MinHash fingerprints of word shingles, in numpy over flat arrays.

A text's shingles are its runs of five words (ASCII white space apart, A-Z in
lower case); a text of fewer words is one shingle, a text of none has none. Each
of 128 universal hash permutations of the 32-bit shingle hashes keeps its least
value; the fingerprint holds the low 16 bits of each. The share of equal places
estimates the Jaccard similarity.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._tables import id_batches, lookup, packed, text_digest, written
from ._text import LOWER, NOT_SPACE, WordHash, flat, mix, slices, windows, words
from .components import components

SHINGLE_WORDS = 5
PERMUTATIONS = 128
ROWS_PER_BATCH = 2_000
#: Rows of the table of batch neighbours up to which it is broadcast (32 bytes each).
NEIGHBOURS_BROADCAST = 500_000

WORD_HASH = WordHash(6)
BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_rng = np.random.Generator(np.random.PCG64(128))
#: An odd factor and any addend permute the 32-bit numbers.
FACTORS = _rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADDENDS = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
EMPTY = np.uint32(0xFFFFFFFF)


def shingle_hashes(column: pa.Array, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles, and how many each text has."""
    data, offs = flat(column)
    data = LOWER[data]
    begin, end, first = words(data, offs, NOT_SPACE)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(column)), count)
    h = WORD_HASH(data, begin, end)
    value = windows(h, k, BASE)
    whole = owner[:len(value)] == owner[k - 1:] if len(value) else np.zeros(0, bool)
    value, owner = value[whole], owner[:len(whole)][whole]
    short = [np.flatnonzero(count == n) for n in range(1, k)]
    if sum(map(len, short)):
        heads = [windows(h, n, BASE)[first[at]] + np.uint64(n) for n, at in zip(range(1, k), short) if len(at)]
        value, owner = np.concatenate([value, *heads]), np.concatenate([owner, *short])
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return mix(value), np.bincount(owner, minlength=len(column))


def signatures(column: pa.Array, k: int = SHINGLE_WORDS) -> np.ndarray:
    """A row of 128 16-bit values for each text; all ones for a text without words."""
    value, count = shingle_hashes(column, k)
    out = np.full((len(column), PERMUTATIONS), EMPTY, np.uint32)
    own = np.flatnonzero(count)
    if len(own):
        x = (value >> np.uint64(32)).astype(np.uint32)
        head = (np.cumsum(count) - count)[own]
        turned = np.empty_like(x)
        least = np.empty((PERMUTATIONS, len(own)), np.uint32)
        for i in range(PERMUTATIONS):
            np.multiply(x, FACTORS[i], out=turned)
            turned += ADDENDS[i]
            np.minimum.reduceat(turned, head, out=least[i])
        out[own] = least.T
    return (out & np.uint32(0xFFFF)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places, row by row."""
    return (a == b).mean(1)


def as_hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows.astype(">u2")]


def _edited(schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        table = table.set_column(table.schema.get_field_index("text"), "text", pc.fill_null(table.column("text"), ""))
        table = table.sort_by([("guest", "ascending"), ("id", "ascending"), ("text", "ascending")]).combine_chunks()
        guest = table.column("guest").to_pylist()
        texts = table.column("text").to_pylist()
        n = guest.index(True)
        if not n:
            return schema.empty_table()
        own, after = texts[:n], [*texts[1:n], texts[n]]
        edited = [t[:len(t) - len(t) // 4] + u[:len(t) // 4] for t, u in zip(own, after)]
        both = [np.concatenate([signatures(p.column("text")) for p in slices(pa.RecordBatch.from_arrays([pa.array(x)], ["text"]), "text")]) for x in (texts[:n + 1], edited)]
        sign, sign_edited = both[0][:n], both[1]
        return pa.Table.from_arrays([
            table.column("row").slice(0, n), table.column("id").slice(0, n),
            pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array(as_hex(sign)), pa.array(as_hex(sign_edited)),
            pa.array(likeness(sign, sign_edited)), pa.array(likeness(sign, both[0][1:]))], schema=schema)

    return run


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each whole text and of its edited text, beside the next document's.

    The edited text ends with the first floor(n_chars / 4) code points of the
    next document (in ascending id; after the last, the first) in place of its
    own last ones. Out: row (the other columns), id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    A null text counts as empty, a null id as the least. Rows with equal ids
    follow in the order of their texts (null as empty); among repeated rows any order gives
    equal results. A single row is its own next. Texts of no words have one
    fingerprint, alike only to itself.
    """
    rows, lower = id_batches(packed(docs, id_col, text_col), "id", ROWS_PER_BATCH, "batch")
    # the first id of each batch that has rows; one number for ROWS_PER_BATCH rows reaches the driver
    firsts = sorted(tuple(r) for r in rows.groupBy("batch").agg(F.min("id").alias("id")).collect())
    guests = [(firsts[(i + 1) % len(firsts)][1], b) for i, (b, _) in enumerate(firsts)]
    table = docs.sparkSession.createDataFrame(guests, "id long, before long")
    if len(guests) <= NEIGHBOURS_BROADCAST:
        table = F.broadcast(table)
    own = F.array(F.struct(F.col("batch").alias("at"), F.lit(False).alias("guest")))
    other = F.array(F.struct(F.col("before").alias("at"), F.lit(True).alias("guest")))
    dealt = rows.join(table, "id", "left") \
        .withColumn("to", F.explode(F.when(F.col("before").isNull(), own).otherwise(F.concat(own, other)))) \
        .select("row", "id", "text", F.col("to.at").alias("at"), F.col("to.guest").alias("guest"))
    schema = T.StructType([dealt.schema["row"], dealt.schema["id"], T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")],
                           *[T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]])
    return dealt.repartition(len(lower), "at").groupBy("at").applyInArrow(_edited(to_arrow_schema(schema)), schema)


# ------------------------------------------------------------ near duplicates

BANDS, BAND_ROWS = 20, 6
#: Least Jaccard similarity of near duplicates, and how far below it an estimate still asks for verification (three deviations).
SIMILARITY, MARGIN = 0.8, 0.11
#: Members of a band bucket that one task compares with as many others.
BUCKET_BLOCK = 4_000
COMPARE_ROWS = 256


def _signed_rows(k: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sign = signatures(part.column("text"), k)
                keys = [mix(windows(sign[:, b * BAND_ROWS:(b + 1) * BAND_ROWS].astype(np.uint64).ravel(), BAND_ROWS, BASE)[::BAND_ROWS] + np.uint64(b)) for b in range(BANDS)]
                flat_keys = np.stack(keys, 1).view(np.int64).ravel()
                bands = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS), pa.array(flat_keys))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.tobytes() for s in sign], pa.binary()), bands], ["id", "sign", "bands"])

    return run


def _proposals(batches):
    """Of each bucket, links between classes that the signatures make likely: a spanning forest, likeliest first.

    Rows come sorted by bucket; side tells the two halves of a block pair apart.
    """
    def forest(rows: pa.Table):
        ids, classes = rows.column("id").to_numpy(), rows.column("class").to_numpy()
        if len(np.unique(classes)) < 2:
            return []
        sign = np.frombuffer(b"".join(rows.column("sign").to_pylist()), np.uint16).reshape(-1, PERMUTATIONS)
        refused = [set(x or ()) for x in rows.column("refused").to_pylist()]
        found = []
        for a in range(0, len(ids), COMPARE_ROWS):
            same = (sign[a:a + COMPARE_ROWS, None, :] == sign[None, :, :]).mean(2) if len(ids) <= 2 * COMPARE_ROWS else np.stack([(sign[i] == sign).mean(1) for i in range(a, min(a + COMPARE_ROWS, len(ids)))])
            x, y = np.nonzero((same >= SIMILARITY - MARGIN) & (classes[a:a + COMPARE_ROWS, None] != classes[None, :]) & (ids[a:a + COMPARE_ROWS, None] < ids[None, :]))
            # between two classes the likeliest pairs come first; a refused pair is never proposed again
            for s, i, j in sorted(zip(-same[x, y], (x + a).tolist(), y.tolist())):
                if ids[j] not in refused[i]:
                    found.append((s, i, j))
        root = {c: c for c in classes.tolist()}

        def top(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        links = []
        for _, i, j in sorted(found):
            a, b = top(int(classes[i])), top(int(classes[j]))
            if a != b:
                root[a] = b
                links.append((int(ids[i]), int(ids[j])))
        return links

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        keys = held.column("bucket").to_numpy()
        cuts = np.append(0, np.flatnonzero(np.diff(keys)) + 1)
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield _link_batch(forest(held.slice(a, b - a)))
        held = held.slice(int(cuts[-1]))
    if held is not None and held.num_rows:
        yield _link_batch(forest(held))


def _link_batch(links):
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])


def near_duplicate_classes(docs: DataFrame, k: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id of every row: texts are linked at a Jaccard similarity of SIMILARITY or more over k-word shingles.

    Equal texts are one node, named by the least id among them. Distinct texts
    that agree on a whole band of their signature meet in a bucket (a pair at
    similarity 0.8 meets with a chance of 0.998). Buckets propose links between
    classes, as a spanning forest and never as all pairs; each proposal is
    verified by the exact similarity of the shingle sets; verified links join
    classes, refused pairs are remembered, and buckets propose again until
    none has a likely pair left between two classes. So no likely link between
    different texts is lost. A large bucket is dealt to tasks as pairs of blocks.

    class_id is the least id of the class; a null id counts as the least.
    Texts without words are one class. Repeated rows come out once each.
    """
    spark = docs.sparkSession
    rows = packed(docs.select(id_col, text_col), id_col, text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text", F.when(F.trim(F.col("text")) == "", F.lit("")).otherwise(F.col("text")))
    keyed = written(rows.select("id", text_digest(F.col("text"), 256).alias("key")), "minhash-rows")
    copies = written(keyed.groupBy("key").agg(F.min("id").alias("node"), F.count("*").alias("n")), "minhash-copies")
    first = copies.select(F.col("node").alias("id"), F.col("key").alias("k"))
    texts = rows.withColumn("k", text_digest(F.col("text"), 256)).join(first, ["id", "k"], "left_semi").dropDuplicates(["id", "k"])
    # an id may name several texts: nodes are numbered by digest
    nodes = texts.select(F.xxhash64("k").alias("id"), "text")
    signed = written(nodes.mapInArrow(_signed_rows(k), "id long, sign binary, bands array<long>"), "minhash-signatures")
    in_band = signed.select("id", F.explode("bands").alias("bucket"))
    size = in_band.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / BUCKET_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int")
    in_band = in_band.join(size, "bucket").select("id", "bucket", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    in_band = written(in_band.select("id", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket")).distinct(), "minhash-buckets")
    sets = written(nodes.mapInArrow(_shingle_sets(k), "id long, shingles array<long>").join(in_band.select("id").distinct(), "id", "left_semi"), "minhash-shingles")
    classes = signed.select("id", F.col("id").alias("class"))
    links = refused = spark.createDataFrame([], "a long, b long")
    tasks = max(1, in_band.count() // 200_000 + 1)
    while True:
        members = in_band.join(signed.select("id", "sign"), "id").join(classes, "id") \
            .join(refused.groupBy(F.col("a").alias("id")).agg(F.collect_set("b").alias("refused")), "id", "left")
        asked = written(members.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_proposals, "a long, b long").distinct(), "minhash-proposals")
        if not asked.limit(1).count():
            break
        both = asked.join(sets.withColumnRenamed("id", "a").withColumnRenamed("shingles", "x"), "a").join(sets.withColumnRenamed("id", "b").withColumnRenamed("shingles", "y"), "b")
        union = F.size("x") + F.size("y") - F.size(F.array_intersect("x", "y"))
        judged = written(both.select("a", "b", (F.size(F.array_intersect("x", "y")) >= SIMILARITY * union).alias("near")), "minhash-judged")
        links = written(links.union(judged.where("near").select("a", "b")), "minhash-links")
        refused = written(refused.union(judged.where("not near").select("a", "b")), "minhash-refused")
        roots = components(links).withColumnRenamed("node", "id")
        classes = written(signed.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("class")), "minhash-classes")
    named = copies.withColumn("id", F.xxhash64("key")).join(classes, "id")
    least = named.groupBy("class").agg(F.min("node").alias("class_id"))
    return lookup(keyed, named.join(least, "class").select("key", "class_id"), "key", copies.select("key", "n")).select("id", "class_id")


def _shingle_sets(k: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                value, count = shingle_hashes(part.column("text"), k)
                ends = np.cumsum(count)
                sets = [np.unique(value[e - n:e]).view(np.int64) for e, n in zip(ends, count)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return run
