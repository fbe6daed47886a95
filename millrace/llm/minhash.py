"""Near-duplicate classes by BagMinHash signatures, banding and verified multiset overlap.

Similarity is the weighted Jaccard index of the multisets of ``gram``-word
shingles (a shorter text is one shingle).

Signatures. A shingle of weight w stands for the weights [0, w). They are cut
at powers of two; every piece has a Poisson process of its own, seeded by
shingle and piece, whose points have a time, a register and a place in the
piece. Pieces below w count in full, the piece that w ends in counts the points
below w. A register keeps its earliest point, so two texts agree in a register
with probability equal to their similarity. Points past the time by which a
text's registers are full are never generated; if one is still empty the time
is doubled for that text.

Bands. ``bands`` groups of ``rows`` registers: at a similarity of 0.8 all 24
groups of 4 differ with probability 3e-6.

Links. Equal texts are one node from the start. In each bucket the texts are
compared with one leader, not with each other: the text that shares its bands
with the most others, so of texts edited from one original the least edited. After
the links' components are known, a bucket that still holds several is settled:
if it holds at most ``SMALL`` texts and ``SETTLE`` outside its largest component,
those outside are paired with all others there; else all outside the largest are
compared with all others in blocks of ``BLOCK`` texts: a task holds two blocks,
counts the overlaps of all their pairs by a product of matrices and returns only
links that join components, so every pair that shares a band is decided and no
pair is written out. Time in such a bucket still grows with the square of the
texts outside its largest component. Outside the blocks a pair must agree in over
half of the registers before its texts are compared, which a pair of similarity
0.8 misses more rarely than once in 1e9. Each link is decided by the exact
overlap of the two multisets.

Nothing is collected; components are found by rounds of joins, each written to
the shared folder. Comparisons of a leader with many texts are dealt out in
groups of ``GROUP``.

Defined results: null texts and texts without words are alone in their class;
equal texts share a class; a class is named by its smallest id (null ids last);
rows that repeat an id are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fingerprints as fp
from .shared import WORD, discarded, written

GRAM = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
SETTLE = 4
SMALL = 16
BLOCK = 1000
COLUMNS = 4096
GROUP = 100
GROUP_BYTES = 4_000_000
SLICE_BYTES = 2_000_000


def shingles(column, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) of every distinct shingle of every row, sorted, and each row's total weight."""
    values, offsets = fp.words(*fp.text_bytes(column))
    n_words = np.diff(offsets)
    rolling = fp.Rolling(values)
    start = np.flatnonzero(np.arange(len(values)) + gram <= fp.row_ends(offsets))
    row = np.searchsorted(offsets, start, side="right") - 1
    short = np.flatnonzero((n_words > 0) & (n_words < gram))
    key = np.concatenate((rolling.at(start, np.full(len(start), gram)), rolling.at(offsets[short], n_words[short])))
    row = np.concatenate((row, short))
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])))) if len(row) else row
    weight = np.diff(first, append=len(row))
    return row[first], key[first], weight, np.bincount(row, minlength=len(n_words))


def sliced_shingles(column, gram: int, limit: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``shingles`` over slices of about ``limit`` bytes: the working arrays of one slice at a time."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    parts, start = [], 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        row, key, weight, total = shingles(column.slice(start, end - start), gram)
        parts.append((row + start, key, weight, total))
        start = end
    return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else shingles(column, gram)


def _uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from 53 bits."""
    return ((x >> fp.U64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(row: np.ndarray, key: np.ndarray, weight: np.ndarray, total: np.ndarray, registers: int) -> np.ndarray:
    """The registers of each row, as the bits of point times; a row without shingles has infinities."""
    out = np.full((len(total), registers), np.inf)
    piece_row, piece_seed, low, size, top = [], [], [], [], []
    k = 0
    while True:
        begin, width = (0, 1) if k == 0 else (1 << (k - 1), 1 << (k - 1))
        some = weight > begin
        if not some.any():
            break
        piece_row.append(row[some])
        piece_seed.append(fp.mix(key[some] + np.full(1, k + 1, fp.U64) * fp.U64(0xD6E8FEB86659FD93)))
        low.append(np.full(int(some.sum()), float(begin)))
        size.append(np.full(int(some.sum()), float(width)))
        top.append(weight[some].astype(np.float64))
        k += 1
    if not piece_row:
        return out.view(fp.U64)
    piece_row, piece_seed, low, size, top = map(np.concatenate, (piece_row, piece_seed, low, size, top))
    limit = (np.log(registers) + 4.0) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        alive = np.flatnonzero(todo[piece_row])
        when = np.zeros(len(alive))
        step = 1
        while len(alive):
            draw = fp.mix(piece_seed[alive] + np.full(1, 3 * step, fp.U64) * fp.U64(0x9E3779B97F4A7C15))
            when = when - np.log(_uniform(draw)) / (registers * size[alive])
            going = when <= limit[piece_row[alive]]
            alive, when, draw = alive[going], when[going], draw[going]
            where = low[alive] + size[alive] * _uniform(fp.mix(draw + fp.U64(1)))
            hit = where <= top[alive]
            register = (fp.mix(draw + fp.U64(2)) % fp.U64(registers)).astype(np.int64)
            np.minimum.at(out.reshape(-1), piece_row[alive][hit] * registers + register[hit], when[hit])
            step += 1
        todo &= ~np.isfinite(out).all(axis=1)
        limit[todo] *= 2
    return out.view(fp.U64)


def _slices(whole: pa.RecordBatch, column: int = 2, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each; Spark bounds the batch itself by bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < whole.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right")))
        yield whole.slice(start, end - start)
        start = end


def _sign(registers: int, bands: int, gram: int):
    per = registers // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                row, key, weight, total = shingles(batch.column(2), gram)
                signed = signatures(row, key, weight, total, registers)
                keys = np.zeros((len(total), bands), fp.U64)
                for i in range(per):
                    keys = fp.mix(keys ^ signed[:, i::per][:, :bands]) + fp.U64(i + 1)
                some = total > 0
                lists = lambda x, kind: pa.array([v if ok else None for v, ok in zip(x, some, strict=True)], pa.list_(kind))
                small = (fp.mix(signed.reshape(-1)).reshape(signed.shape) & fp.U64(0x7FFF)).astype(np.int16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(total, pa.int64()), lists(keys.view(np.int64), pa.int64()), lists(small, pa.int16())],
                    names=["id", "tid", "n", "bands", "sketch"],
                )

    return run


def _likely(a: Column, b: Column, n_a: Column, n_b: Column, registers: int, similarity: float) -> Column:
    """Sizes allow the similarity, and over half of the registers agree."""
    agree = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (F.least(n_a, n_b) >= similarity * F.greatest(n_a, n_b)) & (agree > registers * (similarity - 0.28))


def _compare(gram: int, similarity: float):
    """Texts against their group's leader, for many groups at once."""

    def run(rows):
        row, key, weight, total = sliced_shingles(rows.column("text"), gram)
        code = rows.column("grp").combine_chunks().dictionary_encode()
        code = code.chunk(0) if isinstance(code, pa.ChunkedArray) else code
        salt = rows.column("salt").to_numpy().astype(fp.U64)
        group = fp.mix(code.indices.to_numpy().astype(fp.U64) * fp.U64(0x9E3779B97F4A7C15) + salt)
        leads = rows.column("leads").to_numpy(zero_copy_only=False).astype(bool)
        mixed = fp.mix(key ^ group[row])
        lead = leads[row]
        order = np.argsort(mixed[lead])
        table, its = mixed[lead][order], weight[lead][order]
        other = ~lead
        probe = mixed[other]
        if not len(table):
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        place = np.minimum(np.searchsorted(table, probe), len(table) - 1)
        shared = np.where(table[place] == probe, np.minimum(its[place], weight[other]), 0)
        overlap = np.bincount(row[other], weights=shared, minlength=len(total)).astype(np.int64)
        size_of = dict(zip(group[leads].tolist(), total[leads].tolist(), strict=True))
        both = np.array([size_of.get(g, 0) for g in group.tolist()], np.int64) + total - overlap
        link = np.flatnonzero(~leads & (overlap > 0) & (overlap >= similarity * both - 1e-9))
        return pa.table({"a": rows.column("tid").take(pa.array(link)), "b": rows.column("grp").take(pa.array(link))})

    return run


def verified(pairs: DataFrame, texts: DataFrame, gram: int, similarity: float, mean_bytes: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts' multisets overlap enough; b leads its comparisons, in groups of bounded size."""
    groups = max(1, ceil(2 * pairs.count() * mean_bytes / GROUP_BYTES))
    salts = pairs.groupBy(F.col("b").alias("grp")).agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("salts"))
    led = pairs.withColumnRenamed("b", "grp").join(salts, "grp")
    members = led.select(F.col("a").alias("tid"), "grp", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("leads"))
    leaders = salts.select(F.col("grp").alias("tid"), "grp", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("leads"))
    rows = members.unionByName(leaders).join(texts.select("tid", "text"), "tid").withColumn("part", F.pmod(F.xxhash64("grp", "salt"), F.lit(groups)).cast("int"))
    return rows.groupBy("part").applyInArrow(_compare(gram, similarity), "a binary, b binary")


def _overlaps(row: np.ndarray, key: np.ndarray, weight: np.ndarray, one: np.ndarray, two: np.ndarray, n: int) -> np.ndarray:
    """The multiset overlaps of rows ``one`` with rows ``two``, of n rows in all."""
    order = np.lexsort((row, key))
    row, key, weight = row[order], key[order], weight[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    held = np.bincount(np.cumsum(first) - 1)
    some = np.repeat(held, held) > 1  # a shingle of one text overlaps with nothing
    row, key, weight = row[some], key[some], weight[some]
    # A shingle of weight w is w columns of ones: their products add up to the smaller weight.
    nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    row, key = np.repeat(row, weight), np.repeat(key, weight)
    order = np.lexsort((nth, key))
    row, key, nth = row[order], key[order], nth[order]
    column = np.cumsum(np.concatenate(([False], (key[1:] != key[:-1]) | (nth[1:] != nth[:-1])))) if len(row) else row
    out = np.zeros((len(one), len(two)))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        here = slice(*np.searchsorted(column, (low, low + COLUMNS)))
        ones = np.zeros((n, COLUMNS), np.float32)
        ones[row[here], column[here] - low] = 1
        out += ones[one] @ ones[two].T
    return out


def _block_links(gram: int, similarity: float):
    """All texts of one block against all of another (or the same): links enough to join the components they join."""

    def run(rows):
        row, key, weight, total = sliced_shingles(rows.column("text"), gram)
        left = rows.column("block").to_numpy() == rows.column("i").to_numpy()
        right = rows.column("block").to_numpy() == rows.column("j").to_numpy()
        one, two = np.flatnonzero(left), np.flatnonzero(right)
        overlap = _overlaps(row, key, weight, one, two, len(total))
        both = total[one][:, None] + total[two][None, :] - overlap
        link = (overlap > 0) & (overlap >= similarity * both - 1e-9)
        names: dict[bytes, int] = {}
        label = np.array([names.setdefault(c, len(names)) for c in rows.column("comp").to_pylist()], np.int64)
        found = []
        for a, linked in zip(one, link, strict=True):
            near = two[linked]
            near = near[label[near] != label[a]]
            if len(near):
                joined, at = np.unique(label[near], return_index=True)
                found += [(a, b) for b in near[at]]
                label[np.isin(label, joined)] = label[a]
        tid = rows.column("tid")
        return pa.table({"a": tid.take(pa.array([a for a, _ in found], pa.int64())), "b": tid.take(pa.array([b for _, b in found], pa.int64()))})

    return run


def block_links(open_entries: DataFrame, texts: DataFrame, gram: int, similarity: float) -> DataFrame:
    """Links (a, b) that join the components of each bucket of ``open_entries`` (tid, band, key, comp, most), every pair of two components decided."""
    sized = open_entries.join(texts.select("tid", "size"), "tid").withColumn("outside", F.col("comp") != F.col("most"))
    parts = lambda some: F.greatest(F.ceil(F.sum(some.cast("long")) / BLOCK), F.ceil(F.sum(F.when(some, F.col("size")).otherwise(0)) / (GROUP_BYTES // 2))).cast("int")
    dealt = sized.groupBy("band", "key").agg(parts(F.lit(True)).alias("whole"), parts(F.col("outside")).alias("outer"), parts(~F.col("outside")).alias("inner"))
    dealt = dealt.withColumn("outer", F.greatest("outer", F.lit(1))).withColumn("inner", F.when(F.col("whole") <= 1, 0).otherwise(F.greatest("inner", F.lit(1))))
    share = F.xxhash64("tid")
    block = F.when(F.col("outside") | (F.col("inner") == 0), F.pmod(share, F.col("outer"))).otherwise(F.col("outer") + F.pmod(share, F.col("inner"))).cast("int")
    last = F.when(F.col("block") < F.col("outer"), F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1  # the largest component is not compared with itself
    sent = sized.join(dealt, ["band", "key"]).withColumn("block", block).select("tid", "band", "key", "comp", "block", F.explode(F.sequence(F.lit(0), last)).alias("with"))
    sent = sent.select("tid", "band", "key", "comp", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    return sent.join(texts.select("tid", "text"), "tid").groupBy("band", "key", "i", "j").applyInArrow(_block_links(gram, similarity), "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(tid, comp): each node of ``edges`` (a, b) and the smallest node that it is linked with.

    Every round takes the smallest label among neighbours, then follows labels; rounds grow with the logarithm of a chain's length.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-links")
    labels = written(both.groupBy(F.col("a").alias("tid")).agg(F.least(F.col("tid"), F.min("b")).alias("comp")), "near-labels")
    while True:
        seen = both.join(labels.select(F.col("tid").alias("b"), "comp"), "b").groupBy(F.col("a").alias("tid")).agg(F.min("comp").alias("near"))
        near = labels.join(seen, "tid").select("tid", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("tid").alias("comp"), F.col("comp").alias("next"))
        moved = written(near.join(jump, "comp", "left").select("tid", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp")), "near-labels")
        discarded(labels)
        labels = moved.select("tid", "comp")
        if moved.where("old != comp").isEmpty():
            discarded(both)
            return labels


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, gram: int = GRAM, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, class_id (the smallest id of its class), class_rows, n_shingles, keep (the class has this smallest id)."""
    named = classified(docs, similarity, gram, bands, rows, id_col, text_col)
    order = F.struct(F.col("id").isNull().alias("unknown"), F.col("id"))
    classes = named.where("n > 0").groupBy("comp").agg(F.min(order)["id"].alias("class_id"), F.count(F.lit(1)).alias("class_rows"))
    out = named.join(classes.withColumnRenamed("comp", "of"), (F.col("comp") == F.col("of")) & (F.col("n") > 0), "left")
    return out.select(
        F.col("id").alias(id_col), F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_rows", F.lit(1)).alias("class_rows"), F.col("n").alias("n_shingles"),
        (F.col("of").isNull() | F.col("id").eqNullSafe(F.col("class_id"))).alias("keep"),
    )


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", **more: int) -> DataFrame:
    """``docs`` with one row of each class, that with the smallest id; texts without words all stay."""
    named = classified(docs, similarity, id_col=id_col, text_col=text_col, **more)
    order = F.struct(F.col("id").isNull().alias("unknown"), F.col("id"), F.col("tid"))
    first = named.where("n > 0").groupBy("comp").agg(F.min(order).alias("won")).select(F.col("won")["id"].alias("id"), F.col("won")["tid"].alias("tid"))
    # Rows travel as one struct, so that no name of theirs can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    rows = rows.withColumn("tid", F.unhex(F.sha2(text.cast("binary"), 256))).withColumn("id", F.col("row")[id_col])
    won = rows.join(first.withColumnsRenamed({"id": "won_id", "tid": "won_tid"}), (F.col("tid") == F.col("won_tid")) & F.col("id").eqNullSafe(F.col("won_id")))
    orderable = [F.col("row")[c] for c, kind in docs.dtypes if not re.search("map<|variant", kind)]
    won = won.withColumn("nth", F.row_number().over(Window.partitionBy("tid").orderBy(*orderable))).where("nth = 1")
    return won.select("row").unionByName(rows.where(~text.rlike(WORD)).select("row")).select("row.*")


def classified(docs: DataFrame, similarity: float = SIMILARITY, gram: int = GRAM, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, tid (a digest of its text), n (its shingles), comp (its class's name)."""
    registers = bands * rows
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("tid"), text.alias("text"))
    kind = cut.schema["id"].dataType.simpleString()
    signed = written(cut.mapInArrow(_sign(registers, bands, gram), f"id {kind}, tid binary, n long, bands array<long>, sketch array<short>"), "near-signed")
    nodes = written(signed.where("n > 0").groupBy("tid").agg(F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")), "near-nodes")
    named_rows = written(signed.select("id", "tid", "n"), "near-rows")
    discarded(signed)
    facts = nodes.select("tid", "n", "sketch")

    entries = nodes.select("tid", F.posexplode("bands").alias("band", "key"))
    shared = entries.groupBy("band", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = written(entries.join(shared, ["band", "key"]), "near-entries")
    entries = shared.join(shared.groupBy("tid").agg(F.sum("c").alias("company")), "tid")
    met = entries.groupBy("band", "key").agg(F.max(F.struct("company", "tid"))["tid"].alias("b"))
    entries = written(entries.join(met, ["band", "key"]).select("tid", "band", "key", "b"), "near-entries")
    discarded(shared)
    need = entries.select("tid").distinct()
    texts = written(cut.select("tid", "text").join(need, "tid", "left_semi").groupBy("tid").agg(F.any_value("text").alias("text")).withColumn("size", F.octet_length("text")), "near-texts")
    mean_bytes = texts.agg(F.coalesce(F.avg("size"), F.lit(0.0))).first()[0]

    def likely(pairs: DataFrame) -> DataFrame:
        one = facts.select(F.col("tid").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
        two = facts.select(F.col("tid").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
        both = pairs.join(one, "a").join(two, "b")
        return both.where(_likely(F.col("s_a"), F.col("s_b"), F.col("n_a"), F.col("n_b"), registers, similarity)).select("a", "b")

    def pair(x: str, y: str) -> list[Column]:
        return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]

    done = written(likely(entries.where("tid != b").select(*pair("tid", "b")).distinct()), "near-pairs")
    edges = written(verified(done, texts, gram, similarity, mean_bytes), "near-edges")
    comps = components(edges)

    def unsettled(some: DataFrame) -> DataFrame:
        """The entries of buckets that hold several components, with these."""
        named = some.join(comps, "tid", "left").withColumn("comp", F.coalesce("comp", "tid"))
        held = named.groupBy("band", "key", "comp").agg(F.count(F.lit(1)).alias("c"))
        held = held.groupBy("band", "key").agg(F.sum("c").alias("c"), F.max("c").alias("top"), F.max_by("comp", "c").alias("most"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
        return named.join(held, ["band", "key"])

    many = (F.col("c") - F.col("top") > SETTLE) | (F.col("c") > SMALL)
    named = written(unsettled(entries.select("tid", "band", "key")).withColumn("many", many), "near-open")
    few = named.where("not many")
    lead = few.where("comp != most").select("band", "key", F.col("tid").alias("x"), F.col("comp").alias("x_comp"))
    pairs = lead.join(few.select("band", "key", F.col("tid").alias("y"), F.col("comp").alias("y_comp")), ["band", "key"]).where("x_comp != y_comp")
    fresh = written(likely(pairs.select(*pair("x", "y")).distinct().join(done, ["a", "b"], "left_anti")), "near-pairs")
    if not fresh.isEmpty():
        more = written(verified(fresh, texts, gram, similarity, mean_bytes), "near-edges")
        edges = edges.unionByName(more)
        if not more.isEmpty():
            comps = components(edges)
    # All other buckets: all pairs of what is still apart are decided in blocks.
    left = written(unsettled(named.where("many").select("tid", "band", "key")), "near-open")
    if not left.isEmpty():
        more = written(block_links(left, texts, gram, similarity), "near-edges")
        if not more.isEmpty():
            comps = components(edges.unionByName(more))

    return named_rows.join(comps, "tid", "left").select("id", "tid", "n", F.coalesce("comp", "tid").alias("comp"))
