"""Operator 1: MinHash near-dedup with sequential Bayesian verification.

Each document is its set of distinct 5-word shingles over words with A-Z in lower case. Documents
of equal sets (by 128 bits of two independent hashes of the words) form a class, and one document stands for it. Representatives meet in
bands of 5 minimum hashes; there are as many bands as leave a pair at the threshold unmet with
less than the chosen probability. In each bucket every member is paired with one centre: the member
that agrees best with the bucket's commonest hashes, so that in a group of variants it is the text
they derive from. Chunks of documents propose centres and pair their own members with the chosen
one, so no bucket is gathered, and pairs grow as memberships do, not as their squares.

A pair's signatures are compared 12 hashes at a time. With a uniform prior, similarity s after m of
n equal hashes has the posterior Beta(m+1, n-m+1); the pair is dropped once P(s >= threshold) is
below the miss probability. Survivors are verified on their full shingle sets.

Pairs of a bucket that its star left out matter only if some star pair of that bucket failed and
its two sides are still in different components. Members of such buckets are compared across
components, in blocks, with the same pruning and verification, so no link is lost to the star.

Defined results: a document without words has n_shingles 0 and is its own component; fewer than
five words are one shingle; a repeated doc_id is one document, its smallest text; rows without
doc_id are left out; extra columns are ignored; texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import rendezvous as rv
from weft.llm.core import Words, buffer, cut, joined, keyed, longs, mixed, runs, slices, tidied, tidied_group
from weft.llm.graph import HEAVY, components, lookup

SHINGLE = 5
ROWS = 5
STEP = 12
#: Members of a bucket that are compared with one another at a time when its star did not settle it.
BLOCK = 1024
#: Members of a bucket, evenly spaced, whose commonest hashes are its consensus; all are compared with it.
CONSENSUS = 64


def bands_for(threshold: float, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(threshold**ROWS)))


def least_equal(n: int, threshold: float, miss: float) -> int:
    """The fewest equal hashes of n at which P(similarity >= threshold) is still at least miss."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def shingles_of(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each row the hashes of its shingles in order; fewer than SHINGLE words are one shingle."""
    whole, size = runs(hashes, SHINGLE), np.diff(first)
    short = {n: runs(hashes, n) for n in range(1, SHINGLE) if (size == n).any()}
    return [whole[a : a + n - SHINGLE + 1] if n >= SHINGLE else short[n][a : a + 1] if n else whole[:0] for a, n in zip(first.tolist(), size.tolist(), strict=False)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each row its sorted distinct shingle hashes."""
    for a, b in slices(offsets):
        words = Words(data, offsets[a : b + 1], lower=True)
        yield from map(np.unique, shingles_of(words.hash, words.first))


def strong_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """For each row its sorted distinct shingle hashes, and 128 bits that say which words make up its set.

    Each shingle has two independent 64-bit hashes of its words, one of which makes the set; both
    are summed, mixed, over the set.
    """
    with np.errstate(over="ignore"):
        for a, b in slices(offsets):
            words = Words(data, offsets[a : b + 1], lower=True)
            for one, two in zip(shingles_of(words.hash, words.first), shingles_of(words.other(), words.first), strict=True):
                own, at = np.unique(one, return_index=True)
                yield own, mixed(own).sum().astype(np.int64), mixed(joined(own, two[at])).sum().astype(np.int64)


def signature(shingles: np.ndarray, factors: np.ndarray, addends: np.ndarray) -> np.ndarray:
    """16 bits of each minimum hash (32-bit multiply-add permutations of the folded shingles)."""
    x, least = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32), np.full(len(factors), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 1024):
            np.minimum(least, (factors[:, None] * x[None, at : at + 1024] + addends[:, None]).min(axis=1), out=least)
    return mixed(least.astype(np.uint64)).astype(np.uint16)


def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20250101)
    return rng.integers(0, 1 << 31, k, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, k, np.uint32)


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each document and band."""
    n, k = signatures.shape
    s = signatures.astype(np.uint64).reshape(n, k // ROWS, ROWS)
    key = np.broadcast_to(np.arange(k // ROWS, dtype=np.uint64), (n, k // ROWS)).copy()
    for i in range(ROWS):
        key = mixed(key * np.uint64(0x100000001B3) + s[:, :, i] + np.uint64(1))
    return key


def buckets(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (key, doc) and where each key begins in it."""
    order = np.lexsort((doc, key))
    return order, np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]) != 0)


def centres(signatures: np.ndarray, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most typical member of each bucket, as an index into row, and the hashes it shares with the bucket's consensus.

    row: the members' rows by bucket, in the order of their ids; first: where buckets begin. The
    consensus takes the commonest value of each hash; fewer than three members have none (score 0).
    """
    size = np.diff(np.append(first, len(row)))
    best, score = first.copy(), np.zeros(len(first), np.uint8)
    for i in np.flatnonzero(size > 2).tolist():
        mine = signatures[row[first[i] : first[i] + size[i]]]
        if len(mine) > CONSENSUS:  # evenly spaced members show what is common
            voters = mine[:: -(-len(mine) // CONSENSUS)]
        else:
            voters = mine
        ranked = np.sort(voters, axis=0)
        run = np.zeros(ranked.shape, np.int16)
        for j in range(1, len(ranked)):
            run[j] = np.where(ranked[j] == ranked[j - 1], run[j - 1] + 1, 0)
        common = ranked[run.argmax(axis=0), np.arange(ranked.shape[1])]
        agree = (mine == common).sum(axis=1)
        best[i], score[i] = first[i] + int(agree.argmax()), min(255, int(agree.max()))
    return best, score


class NearDuplicates:
    """One run over docs; see near_duplicates."""

    def __init__(self, docs: DataFrame, threshold: tuple[int, int], miss: float):
        self.docs, self.threshold, self.miss = keyed(docs, "text"), threshold, miss
        self.bands = bands_for(threshold[0] / threshold[1], miss)
        self.parts = rv.parts_for(self.docs)

    def signed(self) -> DataFrame:
        factors, addends = permutations(self.bands * ROWS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size, one, two, sigs = [], [], [], []
                for s, h1, h2 in strong_sets(*buffer(batch.column(1))):
                    size.append(len(s))
                    one.append(h1)
                    two.append(h2)
                    sigs.append(signature(s, factors, addends).tobytes() if len(s) else None)
                yield pa.record_batch([batch.column(0), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "sig"])

        return self.docs.mapInArrow(tidied(run), "doc_id long, n_shingles long, h1 long, h2 long, sig binary")

    def pairs(self, reps: DataFrame) -> DataFrame:
        """Candidate pairs: a, the centre of a bucket, with each other member b.

        Representatives stand in chunks; each chunk names its centre of each bucket, the best of
        those becomes the bucket's centre, and each chunk pairs its own members with that one.
        """
        parts = self.parts

        def keys(table: pa.Table) -> tuple[np.ndarray, ...]:
            doc = longs(table.column("doc_id").combine_chunks())
            table, doc = table.take(pa.array(np.argsort(doc))), np.sort(doc)
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(doc), -1)
            key = bucket_keys(sig)
            row = np.repeat(np.arange(len(doc)), key.shape[1])
            order, first = buckets(key.ravel(), row)
            return doc, sig, key.ravel()[order], row[order], first

        def propose(table: pa.Table) -> pa.Table:
            doc, sig, key, row, first = keys(table)
            at, score = centres(sig, row, first)
            many = np.minimum(np.diff(np.append(first, len(row))), 2).astype(np.uint8)
            key, who = key[first], doc[row[at]]
            part = (key % np.uint64(parts)).astype(np.int64)
            by = np.lexsort((who, part))
            edge = np.flatnonzero(np.diff(part[by], prepend=-1, append=-1))
            rows = [(int(part[by[a]]), -1, rv.pack(who[by[a:b]], key[by[a:b]], score[by[a:b]], many[by[a:b]])) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            return pa.Table.from_batches([rv.batch(rows)])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [rv.unpack(x.as_py(), np.uint64, np.uint8, np.uint8) for b in batches for x in b.column(2)]
            if not got:
                return
            doc, key, score, many = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((doc, -score.astype(np.int64), key))
            doc, key, many = doc[order], key[order], many[order]
            first = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
            size = np.diff(np.append(first, len(key)))
            shared = np.repeat(np.add.reduceat(many.astype(np.int64), first) > 1, size)
            centre, chunk = np.repeat(doc[first], size)[shared], rv.chunk_of(doc[shared], parts)
            by = np.lexsort((centre, chunk))
            edge, key = np.flatnonzero(np.diff(chunk[by], prepend=-1, append=-1)), key[shared][by]
            rows = [(int(chunk[by[a]]), int(chunk[by[a]]), rv.pack(centre[by[a:b]], key[a:b])) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            if rows:
                yield rv.batch(rows).select(["chunk", "blob"])

        def pair(table: pa.Table, found: pa.Table) -> pa.Table:
            got = [rv.unpack(x.as_py(), np.uint64) for x in found.column("blob")]
            if not got or not table.num_rows:
                return pa.table([pa.array([], pa.int64())] * 2, ["a", "b"])
            centre, wanted = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.argsort(wanted)
            centre, wanted = centre[order], wanted[order]
            doc, _, key, row, _ = keys(table)
            at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
            hit = wanted[at] == key
            out = np.unique(np.stack([centre[at[hit]], doc[row[hit]]], 1), axis=0)
            out = out[out[:, 0] != out[:, 1]]
            return pa.table([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

        chunks = reps.select("doc_id", "sig").withColumn("chunk", rv.chunk_column(parts)).groupBy("chunk")
        chosen = chunks.applyInArrow(tidied_group(propose), rv.SCHEMA).repartitionById(parts, "key").mapInArrow(tidied(choose), "chunk int, blob binary")
        return chunks.cogroup(chosen.groupBy("chunk")).applyInArrow(tidied_group(pair), "a long, b long").distinct()

    def sides(self, ids: DataFrame) -> DataFrame:
        """id, sig and shingles (sorted hashes) of the documents with these ids (doc_id)."""
        factors, addends = permutations(self.bands * ROWS)

        def side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = list(shingle_sets(*buffer(batch.column(1))))
                yield pa.record_batch([batch.column(0), pa.array([signature(s, factors, addends).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "sig", "shingles"])

        # a merge join at every size: no side is known to be small
        found = self.docs.join(ids.distinct().hint("merge"), "doc_id", "left_semi").mapInArrow(tidied(side), "id long, sig binary, shingles binary")
        return cut(found.dropDuplicates(["id"]), "sides")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, linked, buckets): buckets that the two share, where they are not linked."""
        (over, under), limits = self.threshold, self.limits()

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                linked, buckets = [], []
                for sa, sb, ta, tb in zip(*(batch.column(i) for i in range(2, 6)), strict=True):
                    sa, sb = np.frombuffer(sa.as_py(), np.uint16), np.frombuffer(sb.as_py(), np.uint16)
                    equal = np.cumsum(sa == sb)
                    yes = all(equal[n - 1] >= least for n, least in limits)
                    if yes:
                        x, y = np.frombuffer(ta.as_py(), np.uint64), np.frombuffer(tb.as_py(), np.uint64)
                        shared = len(x) + len(y) - len(np.union1d(x, y))
                        yes = under * shared >= over * (len(x) + len(y) - shared)
                    linked.append(yes)
                    keys = None
                    if not yes:
                        ka, kb = bucket_keys(np.stack([sa, sb]))
                        keys = ka[ka == kb].view(np.int64)
                    buckets.append(keys)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(buckets, pa.list_(pa.int64()))], ["a", "b", "linked", "buckets"])

        sides = self.sides(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")))
        of = lambda c: sides.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("shingles").alias(f"shingles_{c}"))
        both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "sig_a", "sig_b", "shingles_a", "shingles_b")
        return cut(both.mapInArrow(tidied(decide), "a long, b long, linked boolean, buckets array<long>"), "verdicts")

    def limits(self) -> list[tuple[int, int]]:
        t = self.threshold[0] / self.threshold[1]
        return [(n, least_equal(n, t, self.miss)) for n in range(STEP, self.bands * ROWS + 1, STEP)]

    def rest(self, reps: DataFrame, labels: DataFrame, tested: DataFrame) -> DataFrame | None:
        """Links (a, b) that the stars left out: across components, within buckets in which a star pair failed.

        Members of such a bucket meet in pairs of blocks. A pair belongs to the first bucket that it
        shares; those that the signatures do not rule out stay packed, one row for each two blocks,
        the shingle sets of their documents are brought there, and of what is verified only links
        that join two components leave.
        """
        label = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
        apart = F.coalesce("of_a", "a") != F.coalesce("of_b", "b")
        failed = tested.where("NOT linked").join(label("a"), "a", "left").join(label("b"), "b", "left").where(apart)
        open_keys = cut(failed.select(F.explode("buckets").alias("bucket")).distinct(), "open")
        if open_keys.isEmpty():
            return None

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc = longs(batch.column(0))
                if len(doc):
                    key = bucket_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(doc), -1))
                    yield pa.record_batch([pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(doc, key.shape[1]))], ["bucket", "id"])

        inside = cut(reps.select("doc_id", "sig").mapInArrow(members, "bucket long, id long").join(open_keys.hint("merge"), "bucket"), "members")
        sizes = inside.groupBy("bucket").count().where("count > 2").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
        sizes = cut(sizes, "sizes")
        if sizes.isEmpty():
            return None
        placed = inside.join(sizes, "bucket").join(labels, "id", "left").join(reps.select(F.col("doc_id").alias("id"), "sig"), "id")
        placed = placed.withColumn("component", F.coalesce("component", "id")).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = placed.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "component", "sig")
        limits, (over, under), keys = self.limits(), self.threshold, ["bucket", "low", "high"]

        def across(table: pa.Table) -> pa.Table:
            ids, comp, block = (table.column(c).to_numpy() for c in ("id", "component", "block"))
            place = [table.column(c)[0].as_py() for c in keys]
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)
            own = bucket_keys(sig).view(np.int64)
            got = []
            for i in range(len(ids) - 1):
                b = np.arange(i + 1, len(ids))
                b = b[(comp[b] != comp[i]) & ((block[b] != block[i]) | (place[1] == place[2]))]
                seen, equal = 0, np.zeros(len(b), np.int64)
                for n, least in limits:
                    equal = equal + (sig[b, seen:n] == sig[i, seen:n]).sum(axis=1)
                    b, equal, seen = b[equal >= least], equal[equal >= least], n
                if len(b):
                    first = own[i][(own[b] == own[i]).argmax(axis=1)]
                    got.append(np.stack([np.full(len(b), i), b], 1)[first == place[0]])
            pairs = np.concatenate(got) if got else np.zeros((0, 2), np.int64)
            blob = [rv.pack(ids[pairs[:, 0]], ids[pairs[:, 1]], comp[pairs[:, 0]], comp[pairs[:, 1]])] if len(pairs) else []
            return pa.table([*(pa.array([x][: len(blob)], t) for x, t in zip(place, (pa.int64(), pa.int32(), pa.int32()), strict=True)), pa.array(blob, pa.binary())], [*keys, "blob"])

        plausible = cut(placed.groupBy(*keys).applyInArrow(across, "bucket long, low int, high int, blob binary"), "plausible")
        if plausible.isEmpty():
            return None

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids = np.unique(np.concatenate(rv.unpack(batch.column(3)[i].as_py(), np.int64, np.int64, np.int64)[:2]))
                    yield pa.record_batch([*(pa.array([batch.column(c)[i].as_py()] * len(ids), batch.schema.types[c]) for c in range(3)), pa.array(ids)], [*keys, "id"])

        wanted = cut(plausible.mapInArrow(named, "bucket long, low int, high int, id long"), "wanted")
        sides = self.sides(wanted.select(F.col("id").alias("doc_id"))).drop("sig")

        def links(pairs: pa.Table, sets: pa.Table) -> pa.Table:
            found = []
            if pairs.num_rows:
                shingles = {i: np.frombuffer(x, np.uint64) for i, x in zip(sets.column("id").to_pylist(), sets.column("shingles").to_pylist(), strict=True)}
                root: dict[int, int] = {}

                def top(c: int) -> int:
                    while (up := root.get(c, c)) != c:
                        root[c] = c = root.get(up, up)
                    return c

                for a, b, ca, cb in zip(*(x.tolist() for x in rv.unpack(pairs.column("blob")[0].as_py(), np.int64, np.int64, np.int64)), strict=True):
                    if (ca := top(ca)) != (cb := top(cb)):
                        x, y = shingles[a], shingles[b]
                        if under * min(len(x), len(y)) < over * max(len(x), len(y)):
                            continue
                        shared = len(x) + len(y) - len(np.union1d(x, y))
                        if under * shared >= over * (len(x) + len(y) - shared):
                            root[ca] = cb
                            found.append((a, b))
            return pa.table([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        brought = wanted.join(sides, "id").groupBy(*keys)
        found = cut(plausible.groupBy(*keys).cogroup(brought).applyInArrow(links, "a long, b long"), "rest")
        return None if found.isEmpty() else found

    def run(self) -> DataFrame:
        signed = cut(self.signed(), "signed")
        many = max(2, signed.count() // HEAVY)
        classes = signed.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")).where("copies > 1")
        classes = cut(classes, "classes")
        placed = lookup(signed.where("n_shingles > 0"), classes, ["h1", "h2"], classes.where(F.col("copies") >= many))
        placed = placed.withColumn("class_id", F.coalesce("class_id", "doc_id"))
        placed = placed.withColumn("sig", F.when(F.col("doc_id") == F.col("class_id"), F.col("sig")))
        placed = cut(placed.select("doc_id", "n_shingles", "class_id", "copies", "sig"), "placed")
        reps = placed.where("sig IS NOT NULL")
        tested = self.verified(cut(self.pairs(reps), "pairs"))
        links = tested.where("linked").select("a", "b")
        labels = components(links)
        more = self.rest(reps, labels, tested)
        if more is not None:
            labels = components(links.unionByName(more))
        labels = labels.withColumnRenamed("id", "class_id")
        heavy = classes.where(F.col("copies") >= many).select("class_id").join(labels, "class_id")
        found = lookup(placed.drop("sig", "copies"), labels, ["class_id"], heavy)
        found = found.select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"))
        return found.unionByName(signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = (4, 5), miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    threshold: least Jaccard similarity of a link, as a fraction. miss: the probability with which a
    pair at the threshold may share no band; the pruning has the same bound at each comparison.
    """
    return NearDuplicates(docs, threshold, miss).run()


def query(spark, sf_dir: str) -> DataFrame:
    """op1: components of documents that share 85 of 100 shingles, and which document stays."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), (85, 100))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS sh FROM w
), e AS (
  SELECT DISTINCT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS shared
  FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY ALL
), link AS (
  SELECT a, b FROM p WHERE 100 * shared >= 85 * (na + nb - shared)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
