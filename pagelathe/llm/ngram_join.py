"""Exact Jaccard self-join of documents over word n-grams, as a blocked sparse matrix product.

The product of the document by n-gram incidence matrix with its transpose has the overlap counts. It is taken over
blocks of n-gram columns, and only as far as size bounds leave pairs to find:

1. Every document's distinct n-grams become hashes, keyed by a number drawn for the job; documents with equal sets form one class. A sketch counts
   how common each n-gram is. N-grams are ordered rarest first by it.
2. Two sets of sizes n >= m can reach the threshold only if they share one of the first
   n - ceil(t n) + 1 n-grams in that order. Only those entries, one for a class and task, are shuffled, dealt by
   n-gram: a block of columns a task. Short columns give partial overlap counts of pairs.
3. The counts of a pair are added over the blocks. A pair stays if its count, with the most that the entries not
   compared could add, reaches the overlap that its sizes ask for. No link is lost by this.
4. Columns of more than LONG classes are not expanded. Their classes form groups, which are multiplied by
   themselves in blocks of rows, over all columns, inside tasks. A block has up to BLOCK rows, fewer of large
   sets, and only blocks meet whose sizes allow a link.
5. Pairs that stayed are verified on their whole sets, a class with so many partners at a time as UNIT_ENTRIES
   allows. Links join classes into components.

Equal texts cross the network once, as one class. Of a group of k classes that share long columns, each text crosses
once for every block that it meets: k / BLOCK times at most, and never as pairs.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelathe.llm.common import as_long, components, ranked, scratch, table, written
from pagelathe.llm.shingles import byte_slices, lower_ascii, set_signature, shingle_sets

#: Counters of the sketch, a power of two. Being approximate, they only order the n-grams.
SKETCH_BITS = 22
CHUNK_BITS = 16
#: Columns with more classes than this are multiplied in blocks of rows.
LONG = 24
#: Most rows of a block of a group of classes, and about how many entries a block or a star holds at once.
BLOCK = 256
UNIT_ENTRIES = 1 << 20
_COLUMNS = 8192


def _least(n: np.ndarray | int, num: int, den: int):
    """ceil(n * num / den)"""
    return -(-n * num // den)


def _shingled(batch: pa.RecordBatch, column: int, width: int, key: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row in batch, set) of each text, held a slice at a time."""
    for a in range(0, batch.num_rows, 256):
        texts = [lower_ascii(x) for x in batch.column(column).slice(a, 256).to_pylist()]
        for b, e in byte_slices(texts):
            for k, own in enumerate(shingle_sets(texts[b:e], width, key), a + b):
                yield k, own


def _profiles(docs: DataFrame, width: int, key: int) -> DataFrame:
    """Rows (doc_id, text_key, n, sig) of documents and, of each task, rows (chunk, counts) of its sketch."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << SKETCH_BITS, np.uint32), set()
        for batch in batches:
            n, sig, held = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
            for k, own in _shingled(batch, 2, width, key):
                n[k], sig[k] = len(own), set_signature(own)
                if len(own) and sig[k] not in seen:
                    seen.add(sig[k])
                    held.append(own >> np.uint64(64 - SKETCH_BITS))
            if held:
                # a set counts an n-gram once; equal slots within a batch add up
                slots, times = np.unique(np.concatenate(held), return_counts=True)
                counts[slots] += times.astype(np.uint32)
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), pa.array(sig), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                ["doc_id", "text_key", "n", "sig", "chunk", "counts"],
            )
        pack, size = zstandard.ZstdCompressor(level=1), 1 << CHUNK_BITS
        chunks = [(c, counts[c * size : (c + 1) * size]) for c in range(1 << SKETCH_BITS - CHUNK_BITS)]
        chunks = [(c, pack.compress(x.tobytes())) for c, x in chunks if x.any()]
        none = pa.nulls(len(chunks), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, none, pa.array([c for c, _ in chunks], pa.int32()), pa.array([x for _, x in chunks], pa.binary())],
            ["doc_id", "text_key", "n", "sig", "chunk", "counts"],
        )

    read = docs.select(as_long("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return written(read.mapInArrow(profile, "doc_id long, text_key long, n long, sig long, chunk int, counts binary"), "shingle-profile")


def _frequency(profiles: DataFrame) -> np.ndarray:
    """Frequency class of each counter, 0 to 255: a fixed 4 MB, whatever the data. Sketches are added in two levels."""

    def add(found: pa.Table) -> pa.Table:
        unpack, total = zstandard.ZstdDecompressor(), np.zeros(1 << CHUNK_BITS, np.uint32)
        for x in found.column("counts").to_pylist():
            part = np.frombuffer(unpack.decompress(x), np.uint32)
            total += np.minimum(part, np.uint32(0xFFFFFFFF) - total)
        return pa.table({"chunk": found.column("chunk").slice(0, 1), "counts": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())})

    parts = profiles.where("chunk IS NOT NULL").select("chunk", "counts", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("salt"))
    some = parts.groupBy("chunk", "salt").applyInArrow(lambda t: add(t), "chunk int, counts binary")
    total = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in some.groupBy("chunk").applyInArrow(lambda t: add(t), "chunk int, counts binary").toLocalIterator():
        total[r["chunk"] << CHUNK_BITS : r["chunk"] + 1 << CHUNK_BITS] = np.frombuffer(zstandard.decompress(r["counts"]), np.uint32)
    return np.minimum(255, np.log2(np.maximum(total, 1)) * 8).astype(np.uint8)


def _entries(docs: DataFrame, width: int, num: int, den: int, frequency: np.ndarray, key: int) -> DataFrame:
    """(gram, sig, n): the prefix of each class that a task meets."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, set()
        for batch in batches:
            grams, sigs, sizes = [], [], []
            for _, own in _shingled(batch, 0, width, key):
                if not len(own) or (sig := set_signature(own)) in seen:
                    continue
                seen.add(sig)
                n = len(own)
                keep = n - _least(n, num, den) + 1
                rank = order[own >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(56) | own >> np.uint64(8)
                if keep < n:
                    # ties of the shortened rank are broken by the hash itself, so that all sets agree
                    first = np.lexsort((own, rank))[:keep] if len(np.unique(rank)) < n else np.argpartition(rank, keep - 1)[:keep]
                    own = own[first]
                grams.append(own)
                sigs.append(np.full(len(own), sig, np.int64))
                sizes.append(np.full(len(own), n, np.int32))
            if grams:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(sigs)), pa.array(np.concatenate(sizes))], ["gram", "sig", "n"]
                )

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(emit, "gram long, sig long, n int")


def _column_products(entries: DataFrame, num: int, den: int, long_column: int) -> DataFrame:
    """(a, na, b, nb, shared) partial counts of pairs; and (a, na, b) with shared null: a is in a long column of hub b."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        for batch in batches:
            got = [np.concatenate([r, batch.column(k).to_numpy()]) for k, r in enumerate(rest)]
            if not len(got[0]):
                continue
            cut = int(np.searchsorted(got[0], got[0][-1]))
            rest = [x[cut:] for x in got]
            yield from _columns(*(x[:cut] for x in got), num, den, long_column)
        yield from _columns(*rest, num, den, long_column)

    dealt = entries.repartition("gram").sortWithinPartitions("gram", "n", "sig")
    return dealt.mapInArrow(product, "a long, na int, b long, nb int, shared int")


def _columns(gram: np.ndarray, sig: np.ndarray, n: np.ndarray, num: int, den: int, long_column: int) -> Iterator[pa.RecordBatch]:
    """The products of whole columns, sorted by (gram, n, sig)."""
    if not len(gram):
        return
    new = np.ones(len(gram), np.bool_)
    new[1:] = (gram[1:] != gram[:-1]) | (sig[1:] != sig[:-1])
    gram, sig, n = gram[new], sig[new], n[new]
    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    size = np.diff(np.append(starts, len(gram)))
    first, second = [], []
    for step in range(1, long_column):
        # entries of short columns, each with the entry so many places on
        for_all = np.repeat((size > step) & (size <= long_column), size)
        place = np.arange(len(gram)) - np.repeat(starts, size)
        at = np.flatnonzero(for_all & (place + step < np.repeat(size, size)))
        if not len(at):
            break
        at = at[n[at] >= _least(n[at + step].astype(np.int64), num, den)]
        first.append(at)
        second.append(at + step)
    if first:
        i, j = np.concatenate(first), np.concatenate(second)
        low, high = np.where(sig[i] < sig[j], i, j), np.where(sig[i] < sig[j], j, i)
        order = np.lexsort((sig[high], sig[low]))
        low, high = low[order], high[order]
        head = np.flatnonzero(np.concatenate([[True], (sig[low][1:] != sig[low][:-1]) | (sig[high][1:] != sig[high][:-1])])) if len(low) else np.zeros(0, np.int64)
        if len(head):
            times = np.diff(np.append(head, len(low))).astype(np.int32)
            low, high = low[head], high[head]
            for k in range(0, len(low), 100_000):
                s = slice(k, k + 100_000)
                yield _pair_batch(sig[low[s]], n[low[s]], sig[high[s]], n[high[s]], times[s])
    long = np.repeat(size > long_column, size)
    if long.any():
        hub = np.repeat(sig[starts], size)[long]
        rows = np.unique(np.stack([sig[long], n[long].astype(np.int64), hub]), axis=1)
        yield _pair_batch(rows[0], rows[1].astype(np.int32), rows[2], None, None)


def _pair_batch(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray | None, shared: np.ndarray | None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(na.astype(np.int32)), pa.array(b), none if nb is None else pa.array(nb.astype(np.int32)), none if shared is None else pa.array(shared)],
        ["a", "na", "b", "nb", "shared"],
    )


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: a product over blocks of the columns that both have."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out
    if len(left) == 1 or len(right) == 1:
        one, many = (left[0], right) if len(left) == 1 else (right[0], left)
        counts = np.array([np.isin(x, one, assume_unique=True).sum() if len(one) else 0 for x in many], np.float32)
        return counts.reshape(out.shape)
    a, b = np.concatenate(left), np.concatenate(right)
    columns = np.intersect1d(a, b)
    row_a, row_b = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    col_a, col_b = (np.minimum(np.searchsorted(columns, x), len(columns) - 1) if len(columns) else np.zeros(len(x), np.int64) for x in (a, b))
    in_a, in_b = (columns[c] == x if len(columns) else np.zeros(len(x), np.bool_) for c, x in ((col_a, a), (col_b, b)))
    for k in range(0, len(columns), _COLUMNS):
        parts = []
        for col, row, inside, rows in ((col_a, row_a, in_a, len(left)), (col_b, row_b, in_b, len(right))):
            here = np.flatnonzero(inside & (col >= k) & (col < k + _COLUMNS))
            part = np.zeros((rows, min(_COLUMNS, len(columns) - k)), np.float32)
            part[row[here], col[here] - k] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _unit_links(width: int, num: int, den: int, key: int):
    """Of a unit of rows (role, sig, docs, text): links between roles 0 and 1, or within role 0 if there is no role 1.

    Returns rows (a, b, links): a spanning forest of the links with links null, and with b null, for each
    class, the documents that it links to.
    """

    def verify(rows: pa.Table) -> pa.Table:
        role, sig, docs, text = (rows.column(c).to_pylist() for c in ("role", "sig", "docs", "text"))
        texts, sides = [lower_ascii(x) for x in text], ({}, {})
        for s, e in byte_slices(texts):
            for k, own in enumerate(shingle_sets(texts[s:e], width, key), s):
                if set_signature(own) == sig[k]:
                    sides[role[k]][sig[k]] = (own, docs[k])
        left, right = sides[0], sides[1] or sides[0]
        x, y = list(left), list(right)
        sets = [left[s][0] for s in x], [right[s][0] for s in y]
        shared = _overlaps(*sets).astype(np.int64)
        na, nb = (np.array([len(s) for s in side], np.int64) for side in sets)
        linked = den * shared >= num * (na[:, None] + nb[None, :] - shared)
        weight = np.array([left[s][1] for s in x], np.int64), np.array([right[s][1] for s in y], np.int64)
        if left is right or not sides[1]:
            np.fill_diagonal(linked, False)
            totals = dict(zip(x, (linked @ weight[1]).tolist(), strict=True))
        else:
            totals = dict(zip(x, (linked @ weight[1]).tolist(), strict=True))
            for s, v in zip(y, (linked.T @ weight[0]).tolist(), strict=True):
                totals[s] = totals.get(s, 0) + v
        root: dict[int, int] = {}

        def top(s: int) -> int:
            while (up := root.setdefault(s, s)) != s:
                root[s] = root[up]
                s = up
            return s

        out = []
        for i, j in zip(*(k.tolist() for k in np.nonzero(linked)), strict=True):
            p, q = top(x[i]), top(y[j])
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((x[i], y[j], None))
        out += [(s, None, v) for s, v in totals.items() if v]
        a, b, links = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(links, pa.int64())})

    return verify


def _group_units(members: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """(unit, role, sig): block pairs of the groups of (grp, sig, n); a block holds sets of like size.

    A pair of blocks whose sizes cannot reach the threshold is left out. Blocks are cut by ranks within a group
    and a tenth of size, which no single task has to number; their rows are such that a block holds no more than
    UNIT_ENTRIES entries, or one row.
    """
    sized = members.withColumn("tenth", F.floor(F.log("n") / F.log(F.lit(1.1))).cast("long"))
    rows = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(UNIT_ENTRIES / F.pow(F.lit(1.1), F.col("tenth") + 1)))).cast("long")
    blocks = ranked(sized, ["grp", "tenth"], ["sig"], "nth").withColumn("block", F.col("tenth") * (1 << 40) + F.floor(F.col("nth") / rows)).select("grp", "sig", "n", "block")
    blocks = written(blocks, "blocks")
    ends = blocks.groupBy("grp", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    i, j = ends.select("grp", *[F.col(c).alias(f"i_{c}") for c in ("block", "high")]), ends.select(F.col("grp").alias("g"), *[F.col(c).alias(f"j_{c}") for c in ("block", "low")])
    fits = (F.col("grp") == F.col("g")) & (F.col("i_block") <= F.col("j_block")) & (F.col("i_high") * den >= F.col("j_low") * num)
    pairs = i.join(j, fits).select("grp", "i_block", "j_block", F.xxhash64("grp", "i_block", "j_block").alias("unit"))
    roles = pairs.select("grp", "unit", F.inline(F.expr("filter(array(struct(0 AS role, i_block AS blk), struct(1 AS role, j_block AS blk)), x -> x.role = 0 OR i_block <> j_block)")))
    return roles.join(blocks.select(F.col("grp").alias("g"), "block", "sig"), (F.col("grp") == F.col("g")) & (F.col("blk") == F.col("block"))).select("unit", "role", "sig")


def ngram_join(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, long_column: int = LONG, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of docs (doc_id, text, ...).

    Rows link when den * |A & B| >= num * |A | B| for their sets of width-word n-grams of the text with A-Z lowered.
    A text of fewer words has its whole sequence as its one n-gram. Null texts and texts without words have
    empty sets, link with nothing and are their own component. component_id is the smallest doc_id reachable;
    null doc_ids take part, and have a null component only where no row reached has an id. n_links counts the
    rows linked directly, equal rows included. long_column and block are how work is cut, the result does not
    depend on them. Other columns are ignored; an empty table gives an empty one.
    """
    return linked_rows(docs, width, num, den, long_column, block).select("doc_id", "n_shingles", "component_id", "n_links")


def linked_rows(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, long_column: int = LONG, block: int = BLOCK) -> DataFrame:
    """The rows of ngram_join with their text_key, the rows of their class, and keep_id and keep_key of their component.

    text_key is xxhash64(text). Of a component's (doc_id, text_key), (keep_id, keep_key) is the smallest, null ids last;
    component_id does not tell components apart where ids are null or repeated. Rows with empty sets have nulls there.
    """
    with scratch(docs.sparkSession) as tables:
        profiles, known = _known(docs, width, num, den, long_column, block)
        tables.keep(profiles)
        tables.keep(known)
    rows = profiles.where("chunk IS NULL").select("doc_id", "text_key", "n", "sig")
    full = rows.where("n > 0").join(known, F.col("sig") == F.col("s"))
    out = ("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), "n_links", "text_key", "n_equal", "keep_id", "keep_key")
    none = F.lit(None).cast("long")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), "text_key", none.alias("n_equal"), none.alias("keep_id"), none.alias("keep_key"))
    return full.select(*out).union(empty)


def _known(docs: DataFrame, width: int, num: int, den: int, long_column: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The profile of every row, and of every class of equal sets its component and links."""
    key = secrets.randbits(64)
    profiles = _profiles(docs, width, key)
    rows = profiles.where("chunk IS NULL").select("doc_id", "text_key", "n", "sig")
    frequency = _frequency(profiles)
    classes = written(
        rows.where("n > 0")
        .groupBy("sig")
        .agg(F.count("*").alias("docs"), F.min("n").alias("n"), F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("rep"))
        .select("sig", "docs", "n", "first_id", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key")),
        "classes",
    )
    products = written(_column_products(_entries(docs, width, num, den, frequency, key), num, den, long_column), "products")
    long = products.where("shared IS NULL")
    members = None
    if not long.isEmpty():
        group = components(long.select("a", "b"))
        sizes = long.select(F.col("a").alias("sig"), F.col("na").alias("n")).distinct()
        members = written(sizes.join(group, F.col("sig") == F.col("node"), "left").select("sig", "n", F.coalesce("component", "sig").alias("grp")), "groups")
    # of n entries, all but ceil(t n) - 1 were compared; the rest of the larger set may add as many at most
    asked = F.expr(f"({num}L * (na + nb) + {num + den} - 1) div {num + den}")
    others = F.expr(f"({num}L * greatest(na, nb) + {den} - 1) div {den} - 1")
    pairs = products.where("shared IS NOT NULL").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb")).where(F.col("shared") + others >= asked)
    if members is not None:
        # pairs within a group are found there
        in_a, in_b = members.select(F.col("sig").alias("sa"), F.col("grp").alias("ga")), members.select(F.col("sig").alias("sb"), F.col("grp").alias("gb"))
        pairs = pairs.join(in_a, F.col("a") == F.col("sa"), "left").join(in_b, F.col("b") == F.col("sb"), "left").where("NOT coalesce(ga = gb, false)")
    # a class meets its partners so many at a time as hold UNIT_ENTRIES entries; short columns bound how many it has
    partners = Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    pairs = written(pairs.select("a", "b", F.floor(F.coalesce(F.sum("nb").over(partners), F.lit(0)) / UNIT_ENTRIES).alias("part")), "pairs")
    star = F.xxhash64("a", "part", F.lit("star"))
    units = pairs.select(star.alias("unit"), F.lit(1).alias("role"), F.col("b").alias("sig")).union(pairs.select(star, F.lit(0), "a").distinct())
    if members is not None:
        units = units.union(_group_units(members, num, den, block))
    needed = units.join(classes.withColumnRenamed("sig", "s"), F.col("sig") == F.col("s")).select("unit", "role", "sig", "docs", "rep_id", "rep_key")
    texts = docs.select(as_long("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    with_text = texts.join(needed, (F.col("text_key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("unit", "role", "sig", "docs", "text")
    found = written(with_text.groupBy("unit").applyInArrow(_unit_links(width, num, den, key), "a long, b long, links long"), "links")
    labels = components(found.where("b IS NOT NULL").select("a", "b"))
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    # both sides of the joins on labels and classes are plain tables, whose crowded keys adaptive execution splits
    labelled = written(
        classes.select("sig", "docs", "first_id", "rep_id", "rep_key")
        .join(labels, F.col("sig") == F.col("node"), "left")
        .join(links, F.col("sig") == F.col("a"), "left")
        .select("sig", "docs", "first_id", "rep_id", "rep_key", F.coalesce("component", "sig").alias("label"), F.coalesce("links", F.lit(0)).alias("links")),
        "labelled",
    )
    keep = F.min(F.struct(F.col("rep_id").isNull().alias("none"), "rep_id", "rep_key"))
    smallest = written(labelled.groupBy(F.col("label").alias("l")).agg(F.min("first_id").alias("least"), keep.alias("keep")), "smallest")
    known = labelled.join(smallest, F.col("label") == F.col("l")).select(
        F.col("sig").alias("s"), "least", F.col("docs").alias("n_equal"), F.col("keep.rep_id").alias("keep_id"), F.col("keep.rep_key").alias("keep_key"), (F.col("links") + F.col("docs") - 1).alias("n_links")
    )
    return profiles, written(known, "known")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3])) END) AS gram FROM w
), n AS (
  SELECT w.doc_id, count(gram) AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY 1
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), near AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, near.b FROM r JOIN near ON near.a = r.seen
), c AS (
  SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY 1
), l AS (
  SELECT a AS doc_id, count(*) AS n_links FROM near GROUP BY 1
)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, coalesce(l.n_links, 0) AS n_links FROM n JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
"""


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), width=4, num=85, den=100)
