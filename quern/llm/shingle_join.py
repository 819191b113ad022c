"""Set similarity join on word shingles by vertical partitioning, down to connected classes.

Order. The shingles of all documents are cut into buckets by ranges of their hashes; each bucket counts exactly how many
documents hold each of its shingles, apart from the other buckets. The global order is (number of documents, hash): rare
shingles first. Documents are worked through in slices of bounded size; a shingle that several documents of a slice
hold goes to its bucket once, with their number, so a shingle of a third of all documents is one entry a slice.

Candidates. Documents with equal sets are one class from the start. A pair that reaches the similarity has
need = ceil(4 (n + m) / 9) shingles in common, n and m being the sizes; so the first SHARE of these (all, if need is
less) stand before places n - need + SHARE and m - need + SHARE of the two ordered sets. Each set posts its first
n - ceil(0.8 n) + SHARE shingles with their places, without those that no other document holds, and pairs that match so
often before those places are candidates. In a family of near copies what a member alone holds fills its first places, so
members that differ too much do not meet.
First every posting meets the centre of its list, the document with the fewest rarer shingles; the links found so unite most copies. Then, in lists that still
hold several classes, documents of different classes meet. Pairs inside a class are never made, none across classes is
left out.

Verification. The order is cut into fragments; a fragment of each candidate is a sorted run of
shingles, the two runs of a pair are intersected fragment by fragment, and the partial counts are
summed for each pair.

Shingles are compared by 64-bit hashes, mixed at every eight bytes of a word and at every word of a shingle. The order knows them by
bucket and 32 bits: shingles that agree in those make candidates too many, never too few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, components, ship, slices, table

WORDS = 5
#: Shingles and documents of a slice; a longer document is a slice of its own.
SLICE_SHINGLES, SLICE_DOCS = 2_000_000, 50_000
#: Buckets of the order: so many a shuffle partition, and one for so many bytes of input as the planner estimates them.
BUCKETS_A_PARTITION, BUCKET_BYTES, UNKNOWN_BYTES = 2, 32 << 20, 1 << 60
FRAGMENT_BITS, FILTER_BITS = 3, 24
SHARE = 3
#: A set that more than COPIES documents have deals them to SPREAD tasks when classes are given back.
COPIES, SPREAD = 256, 64
MIX = np.uint64(0x9E3779B97F4A7C15)
LONG_WORD = 64

_BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IN_WORD = ~(((_BYTES >= 9) & (_BYTES <= 13)) | (_BYTES == 32))
#: The bits of the first k bytes of a little-endian number.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, number of words of each text), straight from the column's bytes.

    Eight bytes of a word enter its hash at a time, each time mixed; words of more than LONG_WORD bytes go through xxh3.
    """
    from xxhash import xxh3_64_intdigest

    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    if first == last:
        return np.zeros(0, np.uint64), np.zeros(len(column), np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[first:last]
    bounds = offsets - first
    edges = bounds[:-1][bounds[:-1] < len(data)]
    word = IN_WORD[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins[edges] = word[edges]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    inner = edges[edges > 0] - 1
    ends[inner] = word[inner]
    starts, length = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    length -= starts
    low = np.concatenate([LOWER[data], np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data),), np.dtype("<u8"), low.data, strides=(1,))
    h = length.astype(np.uint64) * MIX
    live = np.arange(len(starts))
    for done in range(0, min(LONG_WORD, int(length.max(initial=0))), 8):
        if done:
            live = live[length[live] > done]
        h[live] = _mixed(h[live] ^ (lanes[starts[live] + done] & FIRST_BYTES[np.minimum(length[live] - done, 8)]))
    for i in np.flatnonzero(length > LONG_WORD):
        h[i] = xxh3_64_intdigest(low[starts[i] : starts[i] + length[i]])
    return h, np.diff(np.searchsorted(starts, bounds))


def shingle_sets(texts: pa.Array, size: int = WORDS) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text, as int64. A-Z are lower-cased; ASCII white space parts words."""
    x, count = word_hashes(texts)
    h = np.full(max(0, len(x) - size + 1), size, np.uint64)  # shingles of all texts; those across two texts are passed over
    for k in range(size):
        h ^= x[k : len(h) + k]
        h *= MIX
        h ^= h >> np.uint64(29)
    h, first, out = h.view(np.int64), 0, []
    for n in count.tolist():
        if n >= size:
            own = np.sort(h[first : first + n - size + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif n:
            out.append(_short(x[first : first + n]))
        else:
            out.append(np.zeros(0, np.int64))
        first += n
    return out


def _short(x: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer words than a shingle has."""
    h = np.full(1, len(x), np.uint64)
    for word in x:
        h ^= word
        h *= MIX
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def need(n, m):
    """Least overlap of sets of n and m shingles that reach a similarity of 0.8."""
    return -(-4 * (n + m) // 9)


def _first_places(n):
    """How many shingles of a set of n have to be posted."""
    return n - -(-4 * n // 5) + SHARE


def _packed(arrays) -> pa.Array:
    return pa.array([None if a is None else a.tobytes() for a in arrays], pa.binary())


class _Slice:
    """Distinct sets of some documents, cut into buckets."""

    def __init__(self, limit: int):
        self.sets: dict[bytes, tuple[int, np.ndarray]] = {}
        self.size, self.limit = 0, limit

    def add(self, doc: int, sig: bytes, tokens: np.ndarray) -> None:
        if sig not in self.sets:
            self.size += len(tokens)
        elif self.sets[sig][0] < doc:
            return
        self.sets[sig] = (doc, tokens)

    def full(self, more: int) -> bool:
        return len(self.sets) >= SLICE_DOCS or self.size > 0 and self.size + more > self.limit

    def rows(self, number: int, buckets: int) -> Iterator[dict]:
        """The head (bucket -1: documents, sizes, signatures, who holds the shared shingles in turn), then a row for each bucket.

        A bucket has how many of its unshared shingles each document holds, these document by document; the shared ones, and how many hold each.
        """
        docs = np.array([d for d, _ in self.sets.values()], np.int64)
        sizes = np.array([len(t) for _, t in self.sets.values()], np.int32)
        token = np.concatenate([t for _, t in self.sets.values()]).view(np.uint64)
        doc = np.repeat(np.arange(len(docs), dtype=np.uint16), sizes)
        sigs = np.frombuffer(b"".join(sig[:8] for sig in self.sets), np.int64)
        order = np.argsort(token, kind="stable")
        ranked = token[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        run = np.diff(first, append=len(ranked))
        shared = np.repeat(run > 1, run)
        many, times = ranked[first[run > 1]], run[run > 1].astype(np.uint32)
        alone = np.empty(len(token), bool)
        alone[order] = ~shared
        one, whose = token[alone], doc[alone]
        cut = lambda t: ((t >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        yield {"bucket": -1, "slice": number, "a": docs, "b": sizes, "c": sigs, "d": doc[order][shared]}
        where = cut(one)
        by = np.argsort(where.astype(np.uint16) if buckets <= 65536 else where, kind="stable")
        one, whose = one[by].astype(np.uint32), whose[by]
        past = np.searchsorted(where[by], np.arange(buckets + 1, dtype=np.uint64))
        past_many = np.searchsorted(cut(many), np.arange(buckets + 1, dtype=np.uint64))
        many = many.astype(np.uint32)
        for k in range(buckets):
            (i, j), (x, y) = past[k : k + 2], past_many[k : k + 2]
            if i < j or x < y:
                held = np.bincount(whose[i:j], minlength=len(docs)).astype(np.uint32)
                yield {"bucket": k, "slice": number, "a": held, "b": one[i:j], "c": many[x:y], "d": times[x:y]}


CUT = "doc long, n long, sig binary, s long, slice long, bucket int, a binary, b binary, c binary, d binary"


def _cut(texts: DataFrame, buckets: int, limit: int) -> DataFrame:
    """A row (doc, n, sig, s) for each document; rows (slice, bucket, a, b, c, d) as _Slice.rows gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        held = _Slice(limit)

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            empty = pa.nulls(len(rows), pa.int64())
            ends = [pa.array([r["slice"] for r in rows], pa.int64()), pa.array([r["bucket"] for r in rows], pa.int32())]
            return pa.RecordBatch.from_arrays([empty, empty, pa.nulls(len(rows), pa.binary()), empty, *ends, *[_packed(r[k] for r in rows) for k in "abcd"]], names=names)

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal held, number
            rows: list[dict] = []
            for row in held.rows(number, buckets):
                rows.append(row)
                if len(rows) == 256:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)
            number += 1
            held = _Slice(limit)

        names = [c.split(" ")[0] for c in CUT.split(", ")]
        for batch in (part for whole in batches for part in slices(whole, "text")):
            sets = shingle_sets(batch.column("text"))
            sigs = [xxh3_128_digest(s.tobytes()) for s in sets]
            blank = pa.nulls(len(sets), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(sigs, pa.binary()),
                    pa.array(np.frombuffer(b"".join(sig[:8] for sig in sigs), np.int64)),
                    pa.nulls(len(sets), pa.int64()),
                    pa.nulls(len(sets), pa.int32()),
                    *[blank] * 4,
                ],
                names=names,
            )
            for doc, sig, tokens in zip(batch.column("doc").to_pylist(), sigs, sets, strict=True):
                if doc is not None and len(tokens):
                    if held.full(len(tokens)):
                        yield from ended()
                    held.add(doc, sig, tokens)
        if held.sets:
            yield from ended()

    return texts.mapInArrow(run, CUT)


def _arrays(table: pa.Table, column: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in table.column(column)]


COUNTED = "slice long, bucket int, a binary, b binary, c binary, d binary, e binary, f binary"


def _counted(rows: pa.Table) -> pa.Table:
    """Answers a bucket: its shingles that several documents hold, with their rank, a logarithm of the number of documents.

    A row for each slice: how many such shingles each document of the slice holds alone in it, these and their ranks; the
    slice's shared ones, how many hold them, and their ranks.
    """
    held, one, many, times = (_arrays(rows, c, np.uint32) for c in "abcd")
    token = np.concatenate([*one, *many])
    ones = sum(map(len, one))
    weight = np.concatenate([np.ones(ones, np.int64), *times])
    order = np.argsort(token, kind="stable")
    ranked = token[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    docs = np.add.reduceat(weight[order], first)
    rank = np.empty(len(token), np.uint16)
    rank[order] = np.repeat(np.where(docs > 1, 256 * np.log2(docs), 0).astype(np.uint16), np.diff(first, append=len(ranked)))
    out: dict[str, list] = {k: [] for k in "abcdef"}
    at, at_many = 0, ones
    for h, o, m, t in zip(held, one, many, times, strict=True):
        r, q = rank[at : at + len(o)], rank[at_many : at_many + len(m)]
        at, at_many = at + len(o), at_many + len(m)
        again = r > 0
        upto = np.concatenate([[0], np.cumsum(again)])
        ends = np.cumsum(h.astype(np.int64))
        for k, x in zip("abcdef", ((upto[ends] - upto[ends - h]).astype(np.uint32), o[again], r[again], m, t, q), strict=True):
            out[k].append(x)
    return pa.table([rows.column("slice"), rows.column("bucket"), *[_packed(out[k]) for k in "abcdef"]], names=["slice", "bucket", *"abcdef"])


POSTS = "token long, doc long, s long, at long"


def _posted(rows: pa.Table) -> pa.Table:
    """The postings of a slice from its head and its buckets' answers: (token, doc, s, at), ``at`` holding size and place.

    Shingles that no other document holds come first in a set and are only counted.
    """
    by = np.argsort(rows.column("bucket").to_numpy(), kind="stable")
    rows = rows.take(pa.array(by))
    head, rest = rows.slice(0, 1), rows.slice(1)
    (docs,), (sizes,), (sigs,), (sharing,) = _arrays(head, "a", np.int64), _arrays(head, "b", np.int32), _arrays(head, "c", np.int64), _arrays(head, "d", np.uint16)
    buckets = rest.column("bucket").to_numpy().astype(np.int64)
    held, one, one_rank, many, times, many_rank = (_arrays(rest, c, kind) for c, kind in zip("abcdef", (np.uint32, np.uint32, np.uint16, np.uint32, np.uint32, np.uint16), strict=True))
    every = np.arange(len(docs))
    none = [np.zeros(0, np.int64)]
    joined = lambda parts: np.concatenate([*none, *parts])
    times_ = joined(times)
    token = np.concatenate([joined((b << 32) | t.astype(np.int64) for b, t in zip(buckets, one, strict=True)), np.repeat(joined((b << 32) | t.astype(np.int64) for b, t in zip(buckets, many, strict=True)), times_)])
    rank = np.concatenate([joined(one_rank), np.repeat(joined(many_rank), times_)])
    whose = np.concatenate([joined(np.repeat(every, h) for h in held), sharing.astype(np.int64)])
    sizes = sizes.astype(np.int64)
    before = sizes - np.bincount(whose, minlength=len(docs))
    upto = _first_places(sizes)
    wanted = before[whose] < upto[whose]
    token, rank, whose = token[wanted], rank[wanted], whose[wanted]
    order = np.lexsort((token, rank, whose))
    token, whose = token[order], whose[order]
    place = np.arange(len(token))
    again = np.concatenate([[False], (token[1:] == token[:-1]) & (whose[1:] == whose[:-1])]) if len(token) else np.zeros(0, bool)
    start = np.searchsorted(whose, every)
    place = place - start[whose] + before[whose]
    if again.any():  # shingles of one document that the order can't tell apart share the earliest place
        starts = np.flatnonzero(~again)
        place = np.repeat(place[starts], np.diff(starts, append=len(place)))
    keep = place < upto[whose]
    token, whose, place = token[keep], whose[keep], place[keep]
    return pa.table([token, docs[whose], sigs[whose], (sizes[whose] << 32) | place], names=["token", "doc", "s", "at"])


def _posts(texts: DataFrame, limit: int) -> tuple[DataFrame, Written]:
    """(documents (doc, n, sig, s), postings of one document for each distinct set)."""
    spark = texts.sparkSession
    estimate = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    by_size = estimate // BUCKET_BYTES if estimate < UNKNOWN_BYTES else 0
    buckets = max(BUCKETS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), by_size)
    cut = Written(_cut(texts, buckets, limit), "slices")
    parts = cut.read().where("slice IS NOT NULL").select("slice", "bucket", "a", "b", "c", "d")
    none = F.lit(None).cast("binary")
    heads = parts.where("bucket < 0").withColumn("e", none).withColumn("f", none)
    answers = parts.where("bucket >= 0").groupBy("bucket").applyInArrow(_counted, COUNTED)
    docs = Written(cut.read().where("sig IS NOT NULL").select("doc", "n", "sig", "s"), "sets").read()
    reps = _reps(docs).select("doc", "s")
    made = heads.union(answers).groupBy("slice").applyInArrow(_posted, POSTS)
    posts = Written(made.join(reps, ["doc", "s"], "left_semi"), "postings")
    cut.discard()
    return docs, posts


def _reps(docs: DataFrame) -> DataFrame:
    return docs.where("n > 0 AND doc IS NOT NULL").groupBy("sig").agg(F.min("doc").alias("doc"), F.first("s").alias("s"))


def _bit(doc) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(doc), 64 - FILTER_BITS)


def _words(ids: DataFrame, key: str) -> DataFrame:
    """A bit set of the keys, of fixed size: 2^FILTER_BITS bits in 2^(FILTER_BITS - 6) rows at most."""
    bit = _bit(F.col(key))
    at = F.shiftright(bit, 6).alias("_word")
    return ids.select(at, bit.bitwiseAND(F.lit(63)).cast("int").alias("_at")).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _at))").alias("_bits"))


def _marked(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``rows`` with _hot: whether their key's bit is set, so true for all of ``ids`` and few others; the bit set is broadcast."""
    bit = _bit(F.col(key))
    found = rows.withColumn("_word", F.shiftright(bit, 6)).withColumn("_at", bit.bitwiseAND(F.lit(63)).cast("int"))
    joined = found.join(F.broadcast(_words(ids, key)), "_word", "left")
    return joined.select(*rows.columns, F.coalesce(F.expr("(shiftrightunsigned(_bits, _at) & 1) = 1"), F.lit(False)).alias("_hot"))


def _picked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc is in ``ids``, and few others: the bit set is broadcast, so texts don't move.

    Rows that only share a bit find no pair later.
    """
    return _marked(rows, "doc", ids).where("_hot").drop("_hot")


def _segments(texts: DataFrame) -> DataFrame:
    """Fragments (doc, s, f, seg) of documents: runs of the shingles sorted by hash, cut at fixed hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        cuts = (np.arange(1, 1 << FRAGMENT_BITS) << (64 - FRAGMENT_BITS)).astype(np.uint64).view(np.int64)
        cuts.sort()
        for batch in (part for whole in batches for part in slices(whole, "text")):
            docs, sigs, parts, runs = [], [], [], []
            for doc, tokens in zip(batch.column("doc").to_pylist(), shingle_sets(batch.column("text")), strict=True):
                sig = int(np.frombuffer(xxh3_128_digest(tokens.tobytes())[:8], np.int64)[0])
                for f, seg in enumerate(np.split(tokens, np.searchsorted(tokens, cuts))):
                    if len(seg):
                        docs.append(doc)
                        sigs.append(sig)
                        parts.append(f)
                        runs.append(seg)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(sigs, pa.int64()), pa.array(parts, pa.int32()), pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int64), *runs]))],
                names=["doc", "s", "f", "seg"],
            )

    return texts.mapInArrow(run, "doc long, s long, f int, seg array<long>")


PAIR = ["u", "v", "su", "sv", "nu", "nv"]


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) whose partial overlaps sum to the similarity."""
    ids = pairs.select(F.col("u").alias("doc")).union(pairs.select(F.col("v").alias("doc")))
    # A row that repeats a document's id and text must not count twice.
    segments = Written(_segments(_picked(texts, ids)).dropDuplicates(["doc", "s", "f"]), "segments").read()
    left = segments.select(F.col("doc").alias("u"), F.col("s").alias("su"), "f", F.col("seg").alias("left"))
    right = segments.select(F.col("doc").alias("v"), F.col("s").alias("sv"), "f", F.col("seg").alias("right"))
    partial = pairs.join(left, ["u", "su"]).join(right, ["v", "sv", "f"]).select(*PAIR, F.size(F.array_intersect("left", "right")).alias("part"))
    total = partial.groupBy(*PAIR).agg(F.sum("part").alias("both"))
    return total.where("100 * both >= 80 * (nu + nv - both)").select("u", "v")


# A posting's second long: set size and place.
_SIZE, _PLACE = "shiftright({0}, 32)", "({0} & 4294967295)"


def _may_link(a: str, b: str) -> F.Column:
    n, m = _SIZE.format(a), _SIZE.format(b)
    least = f"(4 * ({n} + {m}) + 8) DIV 9"
    return F.expr(f"{_PLACE.format(a)} < {n} - {least} + {SHARE} AND {_PLACE.format(b)} < {m} - {least} + {SHARE} AND {least} <= least({n}, {m})")


def _enough(matches: DataFrame) -> DataFrame:
    """Pairs that match often enough, from rows (u, su, au, v, sv, av)."""
    less = F.col("u") < F.col("v")
    turned = [F.when(less, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("u", "v"), ("v", "u"), ("su", "sv"), ("sv", "su"), ("au", "av"), ("av", "au"))]
    sized = matches.select(*turned).select("u", "v", "su", "sv", F.expr(_SIZE.format("au")).alias("nu"), F.expr(_SIZE.format("av")).alias("nv"))
    return sized.groupBy(*PAIR).agg(F.count("*").alias("c")).where(f"c >= least({SHARE}, (4 * (nu + nv) + 8) DIV 9)").drop("c")


def shingle_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_shingles: int = SLICE_SHINGLES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (smallest id that links reach).

    Null texts, and texts without words, have no shingles and link with nothing; so does a row with a
    null id, whose component is null. Rows that repeat an id are told apart by their texts: each has the class of its own text. Other
    columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets, written = _posts(texts, slice_shingles)
    posts = written.read()
    side = lambda x: [F.col("doc").alias(x), F.col("s").alias(f"s{x}"), F.col("at").alias(f"a{x}")]

    # First round: each list's centre meets the others: the document that has the smallest share of its shingles before the list's, so
    # that it differs least from what a family has in common.
    share = (F.expr(_PLACE.format("at")) / F.expr(_SIZE.format("at"))).alias("share")
    centre = posts.groupBy("token").agg(F.min(F.struct(share, "doc", "s", "at")).alias("o"), F.count("*").alias("c")).where("c > 1").select("token", "o.doc", "o.s", "o.at")
    met = posts.select("token", *side("v")).join(centre.select("token", *side("u")), "token").where("u <> v").where(_may_link("au", "av"))
    first = Written(_enough(met), "pairs").read()
    links = Written(_verified(texts, first), "links").read()
    classes = Written(components(links), "classes").read()

    # Second round: in lists of several classes, documents of different classes meet.
    classed = posts.join(classes.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("class", F.coalesce("component", "doc")).drop("component")
    mixed = classed.groupBy("token").agg(F.min("class").alias("main"), F.max("class").alias("last")).where("main <> last").select("token", "main")
    lists = Written(classed.join(mixed, "token"), "lists").read()
    one = lists.where("class <> main").select("token", *side("u"), F.col("class").alias("cu"))
    other = lists.select("token", *side("v"), F.col("class").alias("cv"), "main")
    across = one.join(other, "token").where("cu <> cv AND (cv = main OR u < v)").where(_may_link("au", "av"))
    second = Written(_enough(across).join(first, PAIR, "left_anti"), "pairs").read()
    links = links.union(Written(_verified(texts, second), "links").read())
    classes = Written(components(links), "classes").read()

    live = sets.where("n > 0 AND doc IS NOT NULL")
    of_set = _reps(sets).join(classes.select(F.col("node").alias("doc"), "component"), "doc", "left").select("sig", F.coalesce("component", "doc").alias("component"))
    many = live.groupBy("sig").agg(F.count("*").alias("c")).where(F.col("c") > COPIES)
    marked = lambda rows: _marked(rows, "sig", many.select("sig"))
    dealt = marked(live).select("sig", "doc", "n", F.when(F.col("_hot"), F.pmod(F.xxhash64("doc"), F.lit(SPREAD))).otherwise(0).cast("int").alias("part"))
    copied = marked(of_set).select("sig", "component", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))).alias("part"))
    linked = dealt.join(copied, ["sig", "part"]).select("doc", "n", "component")
    alone = sets.where("n = 0 OR doc IS NULL").select("doc", "n", F.col("doc").alias("component"))
    return linked.union(alone).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_classes(table(spark, sf_dir, "documents"))


def shingle_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class; columns unchanged."""
    kept = shingle_classes(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
