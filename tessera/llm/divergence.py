"""How far the sources of each language lie apart in their words, in exact integer arithmetic.

Texts are cut and counted in numpy, a block at a time: the terms of a block become integers, and counts of each group are
bincounts over those. After the shuffle the kept terms of a language are dealt by hash into chunks. In a chunk the sorted
array of its terms is the dictionary, ids come from ``searchsorted``, and every group is one dense vector of counts, so all
pairs of groups are differences of vectors. Ids keep the UTF-8 order, which settles ties.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, row_blocks, ship, stored, text_bytes, words_of

#: What a share of one is, and what is added to every count.
WHOLE, ADDED = 1_000_000_000, 5
#: Bounds: cells (groups by terms) of one chunk, groups of one block, counted terms and their bytes held by a task, rows
#: of a table that is broadcast.
CELLS, LEAST_CELLS, BLOCK, HELD, HELD_BYTES, SMALL = 1 << 20, 1 << 14, 256, 400_000, 64 << 20, 50_000

#: Bytes that are in no term: ASCII but for letters.
GAPS = np.zeros(256, bool)
GAPS[:128] = True
GAPS[[*range(65, 91), *range(97, 123)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def block_counts(texts, group: np.ndarray, groups: int):
    """Of one block of texts: the terms as an Arrow array, and for each pair of group and term that occurs the group, the
    term's place there, its occurrences and the texts that hold it."""
    import pyarrow as pa

    raw, off = text_bytes(texts)
    starts, ends, of_row = words_of(_LOWER[raw], off, GAPS)
    if not len(starts):
        return pa.array([], pa.large_string()), *(np.zeros(0, np.int64) for _ in range(4))
    letters = _LOWER[raw][~GAPS[raw]]
    stops = np.concatenate([[0], np.cumsum(ends - starts)])
    coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(stops), pa.py_buffer(letters)).dictionary_encode()
    code, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    row = np.repeat(np.arange(len(off) - 1), np.diff(of_row))
    # Each term of each text once, with its occurrences; then by group.
    once = np.sort(row * size + code)
    first = np.flatnonzero(np.append(True, once[1:] != once[:-1]))
    occurs, once = np.diff(np.append(first, len(once))), once[first]
    key = group[once // size] * size + once % size
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    n = np.bincount(np.cumsum(new) - 1, occurs[order]).astype(np.int64)
    docs = np.bincount(np.cumsum(new) - 1)
    return coded.dictionary, key[new] // size, key[new] % size, n, docs


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of each task: occurrences and texts; a row without a term for every group that occurs.

    docs has text, lang, source, null as empty. A task holds at most HELD rows and HELD_BYTES bytes of counts and
    sends them on when they grow beyond; the sums are made after the shuffle."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["lang", "source", "term", "n", "docs"]

        def summed(tables):
            return pa.concat_tables(tables).group_by(names[:3], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(names)

        held, rows, size = [], 0, 0
        for b in batches:
            text, lang, source = (b.column(i) for i in range(3))
            lang, source = (pc.fill_null(x.cast(pa.large_string()), "").dictionary_encode() for x in (lang, source))
            both = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy(zero_copy_only=False)
            pair, group = np.unique(both, return_inverse=True)
            of_lang, of_source = lang.dictionary.take(pa.array(pair // max(1, len(source.dictionary)))), source.dictionary.take(pa.array(pair % max(1, len(source.dictionary))))
            zero = pa.array(np.zeros(len(pair), np.int64))
            held.append(pa.table([of_lang, of_source, pa.nulls(len(pair), pa.large_string()), zero, zero], names))
            length = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in row_blocks(np.concatenate([[0], np.cumsum(length)])):
                terms, g, code, n, held_by = block_counts(text.slice(i, j - i), group[i:j], len(pair))
                g = pa.array(g)
                held.append(pa.table([of_lang.take(g), of_source.take(g), terms.take(pa.array(code)), pa.array(n), pa.array(held_by)], names))
                rows, size = rows + len(g), size + held[-1].nbytes
                if rows > HELD or size > HELD_BYTES:
                    now = summed(held)
                    held, rows, size = [now], len(now), now.nbytes
                    if rows > HELD // 2 or size > HELD_BYTES // 2:
                        yield from now.to_batches(max_chunksize=50_000)
                        held, rows, size = [], 0, 0
        if held:
            yield from summed(held).to_batches(max_chunksize=50_000)

    return map_arrow(docs, run, "lang string, source string, term string, n long, docs long")


def share(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(WHOLE * (count + ADDED) / total), exactly, for totals below 9 * 10^15: long division, three digits a step."""
    a = np.asarray(count, np.int64) + ADDED
    total = np.broadcast_to(np.asarray(total, np.int64), a.shape)
    q, r = np.divmod(a, total)
    for _ in range(3):
        d, r = np.divmod(r * 1000, total)
        q = q * 1000 + d
    return q + 1


def compare_chunk(table, top: int, per_block: int):
    """One chunk of a language's terms, for the groups of one or two blocks: (source, part, item, value) rows.

    table holds a row without a term for each group, with its sum of counts, and a row for each term that occurs there."""
    import pyarrow as pa

    col = lambda name: table.column(name).combine_chunks()
    number, term = col("number").to_numpy(), col("term")
    is_group = term.is_null().to_numpy(zero_copy_only=False)
    order = np.flatnonzero(is_group)[np.argsort(number[is_group])]
    numbers, sums = number[order], col("group_sum").to_numpy()[order]
    source = np.array(col("source").to_pylist(), object)[order]
    terms, lang_sum = int(table.column("terms")[0].as_py()), int(table.column("lang_sum")[0].as_py())
    # The dictionary: sorted terms. Python's order of strings is that of their UTF-8 bytes.
    rows = np.flatnonzero(~is_group)
    spelt = np.array([*term.take(pa.array(rows)).to_pylist(), None], object)[:-1]
    kept = np.array([*sorted(set(spelt)), None], object)[:-1]
    ids = np.searchsorted(kept, spelt).astype(np.int64) if len(kept) else np.zeros(0, np.int64)
    counts = np.zeros((len(numbers), len(kept)), np.int64)
    counts[np.searchsorted(numbers, number[rows]), ids] = col("n").to_numpy()[rows]
    p = share(counts, (sums + ADDED * terms)[:, None]) if len(kept) else counts
    # Terms that none of these groups holds aren't here, but count: every term counts at first as if nobody held it, in the
    # chunk numbered 0, and is taken out again where it is compared.
    nobody = share(np.zeros(len(sums)), sums + ADDED * terms) if terms else sums
    unseen = (terms if table.column("chunk")[0].as_py() == 0 else 0) - len(kept)
    block = numbers // per_block
    own = table.column("a")[0].as_py() == table.column("b")[0].as_py()
    out: list[tuple] = []
    firsts = np.flatnonzero(block == block[0])
    seconds = firsts if own else np.flatnonzero(block != block[0])
    for g in firsts.tolist():
        apart = (np.abs(p[seconds] - p[g]).sum(axis=1) + unseen * np.abs(nobody[seconds] - nobody[g])).tolist()
        for s, value in zip(seconds.tolist(), apart):
            if s != g:
                out.append((source[g], "pair", source[s], value))
                if not own:
                    out.append((source[s], "pair", source[g], value))
    if own and len(kept):
        in_lang = np.zeros(len(kept), np.int64)
        in_lang[ids] = col("lang_n").to_numpy()[rows]
        q = share(in_lang, lang_sum + ADDED * terms)
        for g in firsts.tolist():
            above = np.flatnonzero((counts[g] > 0) & (p[g] > q))
            best = above[np.argsort((q - p[g])[above], kind="stable")[:top]]
            out += [(source[g], "term", kept[i], int(p[g][i] - q[i])) for i in best.tolist()]
    lang = table.column("lang")[0].as_py()
    made = list(zip(*out)) or [[]] * 4
    return pa.table([pa.array([lang] * len(out), pa.string()), *(pa.array(made[i], pa.string()) for i in range(3)), pa.array(made[3], pa.int64())], ["lang", "source", "part", "item", "value"])


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """df for a join, broadcast where it has been counted to be small."""
    return F.broadcast(df) if rows <= SMALL else df


def source_divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, per_block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's words are from other sources' and from its language's.

    Part ``pair`` sets every group (lang, source) against each other source of the language; part ``term`` names up to top
    terms by which it exceeds its language. Terms are runs of letters and non-ASCII characters, A-Z lower-cased; a language
    keeps those in at least least_docs of its rows. Null text, lang and source are empty; repeated rows each count, whatever
    their ids; a group without terms has pairs, and pairs are 0 where a language keeps none. Ties go by the item's UTF-8
    bytes. Other columns are ignored; an empty table gives no rows.

    Counts are combined in the tasks, then by group and term, then by term, so a frequent term or source is no hot key. A
    chunk holds some cells of counts, twice per_block groups by a single term at least; more groups meet block by block."""
    spark = docs.sparkSession
    cut = count_terms(docs.select(*[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")]))
    by_group = cut.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    per_term = Window.partitionBy("lang", "term")
    kept = (
        by_group.withColumns({"in_docs": F.sum("docs").over(per_term), "lang_n": F.sum("n").over(per_term), "first": F.row_number().over(per_term.orderBy("source")) == 1})
        .where(F.col("term").isNull() | (F.col("in_docs") >= least_docs))
        .select("lang", "source", "term", "n", "lang_n", (F.col("first") & F.col("term").isNotNull()).alias("first"))
    )
    kept = stored(kept)
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_sum"), F.sum(F.col("first").cast("long")).alias("firsts"))
    per_lang = Window.partitionBy("lang")
    groups = stored(
        sums.withColumns({"number": F.row_number().over(per_lang.orderBy("source")) - 1, "terms": F.sum("firsts").over(per_lang), "lang_sum": F.sum("group_sum").over(per_lang), "groups": F.count("*").over(per_lang)}).drop("firsts")
    )
    # Chunks share the cells out over the tasks, within the bounds.
    width = F.least("groups", F.lit(per_block))
    n_groups, total = groups.agg(F.count("*"), F.sum(F.col("terms") * width / F.col("groups"))).first()
    each = min(cells, max(LEAST_CELLS, int((total or 0) / (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    of_lang = {"chunks": F.greatest(F.lit(1), F.ceil(F.col("terms") * width / each)).cast("long"), "blocks": F.ceil(F.col("groups") / per_block).cast("long")}
    groups = groups.withColumns(of_lang)
    numbered = _bounded(groups.select("lang", "source", "number", "group_sum", "terms", "lang_sum", "chunks", "blocks"), n_groups)
    counts = kept.where(F.col("term").isNotNull()).join(numbered, ["lang", "source"]).withColumn("chunk", F.expr("pmod(xxhash64(term), chunks)"))
    whole = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("lang_n"), "number", "group_sum", "terms", "lang_sum", "chunks", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    shown = ["lang", "source", "term", "n", "lang_n", "number", "group_sum", "terms", "lang_sum", "chunk", "blocks"]
    dealt = counts.select(*shown).unionByName(whole.select(*shown)).withColumn("own", F.floor(F.col("number") / per_block)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(*[c for c in shown if c != "blocks"], F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    ship(spark)
    made = dealt.groupBy("lang", "chunk", "a", "b").applyInArrow(lambda t: compare_chunk(t, top, per_block), "lang string, source string, part string, item string, value long")
    value = made.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # Every chunk gives its best terms, so the best of all are found in two steps: first of some of the chunks' terms.
    heats = max(1, math.isqrt(max(1, int(total or 0) // each)))
    best = Window.partitionBy("lang", "source", "part", F.pmod(F.xxhash64("item"), F.lit(heats))).orderBy(F.desc("value"), "item")
    some = value.withColumn("rank", F.row_number().over(best)).where((F.col("part") == "pair") | (F.col("rank") <= top))
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(s, 0)::HUGEINT AS s, coalesce(v, 0)::HUGEINT AS v FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN (SELECT lang, source, sum(n) AS s FROM c GROUP BY lang, source) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) USING (lang)),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (s + 5 * v) AS p FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (s + 5 * v) AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term)
      JOIN (SELECT lang, sum(s) AS s, any_value(v) AS v FROM g GROUP BY lang) USING (lang)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 50
"""
