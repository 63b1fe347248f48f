"""How far the sources of a language diverge in the terms they use, with exact integer shares.

A text's UTF-8 bytes go through one translate table that lowers letters and blanks every
other ASCII byte; a split gives the terms and a counter per document their frequencies.
Tasks add up documents before anything is shuffled: a row is a term of a (language, source)
group with its occurrences and its documents.

A group's share of a term is ``p = 1 + floor(10^9 (count + 1) / (N + V))``, and it diverges
from a share ``q`` by ``floor((p - q)^2 / q)``.  Between two sources this is summed over all
``V`` terms of the language.  Only terms that both hold are compared one by one: for a term
that one of them lacks, the other's part depends on the count alone, so counts are enough,
and a term that both lack adds the same each time.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqnet.llm.common import raw_text, sliced
from seqnet.plans.lineage import cut

#: Letters to lower case, all other ASCII bytes to blanks; bytes of other characters as they are.
TABLE = bytes(b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))
#: Documents of a language that a kept term is in, shares of one, and ranks of the term report.
LEAST_DOCS, ONE, TOP = 3, 1_000_000_000, 200
#: Different terms that a task adds up before it sends them on, and pairs that it compares at a time.
HELD_TERMS, HELD_PAIRS = 300_000, 1 << 20

GROUP = ["lang", "source"]


def terms(raw: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return raw.translate(TABLE).split()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents per group and term.

    Every group also has a row without a term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By group: occurrences and documents of each term.
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def flush() -> pa.RecordBatch:
            rows = [(*group, term, n, docs[term]) for group, (times, docs) in held.items() for term, n in times.items()]
            rows += [(*group, None, 0, 0) for group in held]
            held.clear()
            kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["lang", "source", "term", "n", "docs"])

        for batch in sliced(batches):
            for raw, *group in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = Counter(terms(raw))
                times, docs = held[tuple(group)]
                times.update(own)
                docs.update(own.keys())
            if sum(len(times) for times, _ in held.values()) >= HELD_TERMS:
                yield flush()
        if held:
            yield flush()

    groups = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source)]
    found = docs.select(raw_text(text).alias("raw"), groups[0].alias("lang"), groups[1].alias("source"))
    found = found.mapInArrow(run, "lang string, source string, term binary, n bigint, docs bigint")
    return found.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str | int, total: str, kept: str) -> Column:
    """``1 + floor(10^9 (count + 1) / (N + V))``, exact for any count; 1 where no terms are kept."""
    parts = f"cast(nullif(cast({total} as decimal(20, 0)) + {kept}, 0) as decimal(21, 0))"
    return F.expr(f"coalesce((cast({ONE} as decimal(10, 0)) * (cast({count} as decimal(20, 0)) + 1)) div {parts}, 0L) + 1")


def apart(p: str, q: str) -> Column:
    """``floor((p - q)^2 / q)``."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def both_hold(cells: DataFrame) -> DataFrame:
    """``lang, source, item, value``: what terms that two groups hold change against the sums over each one alone.

    ``cells`` has per group and term the share ``p`` and the share ``zero`` of a term that the group lacks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[str, str], int] = {}
        last, waiting = None, []

        def compared(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            """Rows of whole terms, one after the other."""
            ends, group, p, zero = (np.concatenate([part[i] for part in parts]) for i in range(4))
            starts = np.flatnonzero(ends)
            sizes = np.diff(np.append(starts, len(ends)))
            first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
            names = list(codes)
            # Each row meets all rows of its term, some rows at a time.
            at = 0
            while at < len(ends):
                upto = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), HELD_PAIRS)))
                n = size[at:upto]
                a = np.repeat(np.arange(at, upto), n)
                b = np.repeat(first[at:upto], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                a, b = a[a != b], b[a != b]
                at = upto
                if not len(a):
                    continue

                def f(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                    return (x - y) ** 2 // y

                change = f(p[a], p[b]) - f(p[a], zero[b]) - f(zero[a], p[b]) + f(zero[a], zero[b])
                pair, place = np.unique(group[a] * len(names) + group[b], return_inverse=True)
                total = np.zeros(len(pair), np.int64)
                np.add.at(total, place, change)
                left, right = np.divmod(pair, len(names))
                cells = [[names[i][0] for i in left], [names[i][1] for i in left], [names[i][1] for i in right]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cells), pa.array(total)], names=["lang", "source", "item", "value"])

        for batch in batches:
            if not batch.num_rows:
                continue
            lang, source, term = (batch.column(i).to_pylist() for i in range(3))
            group = np.fromiter((codes.setdefault(g, len(codes)) for g in zip(lang, source, strict=True)), np.int64, len(lang))
            keys = list(zip(lang, term, strict=True))
            fresh = np.fromiter((k != before for k, before in zip(keys, [last, *keys[:-1]], strict=True)), bool, len(keys))
            last = keys[-1]
            rows = (fresh, group, batch.column(3).to_numpy(), batch.column(4).to_numpy())
            cut_at = np.flatnonzero(fresh)
            if not len(cut_at):
                waiting.append(rows)
                continue
            whole = waiting + [tuple(c[: cut_at[-1]] for c in rows)]
            if sum(len(part[0]) for part in whole):
                yield from compared(whole)
            waiting = [tuple(c[cut_at[-1] :] for c in rows)]
        if waiting:
            yield from compared(waiting)

    dealt = cells.select("lang", "source", "term", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(run, "lang string, source string, item string, value bigint")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` of each (lang, source) group.

    Part ``pair`` has every other source of the language as item and the divergence from it;
    part ``term`` the kept terms that the group uses more than its language does, the
    ``top`` first ones.  Ranks count from 1 by value, the larger first, then by item.  Null
    texts, languages and sources are empty ones.  Every row is a document of its own, whatever its id.
    A group without terms keeps its rows of part ``pair``; a language without kept terms has
    value 0 there.  An empty table gives an empty result; other columns are ignored.
    """
    counts = cut(term_counts(docs, text, lang, source))
    held = counts.df.filter("term is not null")
    kept = held.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole")).filter(F.col("docs") >= least_docs)
    kept = cut(kept.select("lang", "term", "whole"))
    found = cut(held.join(kept.df, ["lang", "term"]).select(*GROUP, "term", "n", "whole"))
    langs = kept.df.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("whole").alias("whole_total"))
    totals = found.df.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    groups = counts.df.filter("term is null").select(*GROUP).join(totals, GROUP, "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "kept", "whole_total"]).withColumn("zero", share(0, "total", "kept"))
    groups = cut(groups)
    cells = found.df.join(groups.small(), GROUP)
    cells = cells.withColumn("p", share("n", "total", "kept"))

    # Terms above the language's share.
    common = cells.withColumn("q", share("whole", "whole_total", "kept")).filter("p > q")
    over = common.select(*GROUP, F.lit("term").alias("part"), F.decode("term", "UTF-8").alias("item"), apart("p", "q").alias("value"))

    # Pairs: terms that neither holds, then those that one holds by their counts, then those that both hold.
    other = groups.small().select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"))
    different = F.col("source") != F.col("item")
    neither = groups.df.join(other, "lang").filter(different).select(*GROUP, "item", (apart("zero", "item_zero") * F.col("kept")).alias("value"))
    steps = cells.groupBy(*GROUP, "p", "zero").agg(F.count(F.lit(1)).alias("m")).join(other, "lang").filter(different)
    as_group = F.struct("source", "item", (F.col("m") * (apart("p", "item_zero") - apart("zero", "item_zero"))).alias("value"))
    as_item = F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("m") * (apart("item_zero", "p") - apart("item_zero", "zero"))).alias("value"))
    one = steps.select("lang", F.inline(F.array(as_group, as_item))).select(*GROUP, "item", "value")
    pairs = neither.unionByName(one).unionByName(both_hold(cells)).groupBy(*GROUP, "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select(*GROUP, F.lit("pair").alias("part"), "item", "value")

    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    over = over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(over)


def oracle(least_docs: int = LEAST_DOCS, top: int = TOP) -> str:
    """The result of ``audit``, every pair of sources over every kept term."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    p = f"1 + CAST({ONE} AS HUGEINT) * (coalesce(n, 0) + 1) // (total + kept)"
    return rf"""
        WITH docs AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS text
            FROM documents
        ),
        words AS (
            SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
        ),
        kept AS (SELECT lang, term, count(*) AS whole FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= {least_docs}),
        counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
        langs AS (SELECT lang, count(*) AS kept, CAST(sum(whole) AS HUGEINT) AS whole_total FROM kept GROUP BY lang),
        groups AS (
            SELECT lang, source, coalesce(any_value(kept), 0) AS kept, any_value(whole_total) AS whole_total, coalesce(any_value(total), 0) AS total
            FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN langs USING (lang)
            LEFT JOIN (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM counts GROUP BY lang, source) USING (lang, source)
            GROUP BY lang, source
        ),
        cells AS (
            SELECT lang, source, term, n, {p} AS p, 1 + CAST({ONE} AS HUGEINT) * (whole + 1) // (whole_total + kept) AS q
            FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
        ),
        compared AS (
            SELECT a.lang AS lang, a.source AS source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ),
        parts AS (
            SELECT a.lang AS lang, a.source AS source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN compared c ON c.lang = a.lang AND c.source = a.source AND c.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM cells WHERE n > 0 AND p > q
        ),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
        FROM ranked WHERE part = 'pair' OR rank <= {top}
    """
