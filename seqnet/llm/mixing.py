"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells by source, language and topic.  The cells' token weights
are raked to the three marginals in turn: each category's weights are scaled to its target,
and no cell may ask for more tokens than it has.  A document is then sampled with its
cell's calibrated probability, by a hash of its id, so any task decides alike.

The cells stay a table; each step is one job with partial sums per category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqnet.llm.common import fresh
from seqnet.plans.lineage import cut

MARGINS = ("source", "lang", "topic")
MISSING = "(none)"
#: Share of all tokens to keep, exponent that evens out categories, and raking rounds.
BUDGET, EVEN, ROUNDS = 0.5, 0.7, 10
MARKS = "#&$*%!"


def words_in(text: str) -> Column:
    """Number of words; null texts have none."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\x0b\f\r]+")
    edges = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - edges).cast("long")


def topic_of(text: str, words: Column) -> Column:
    """The kind of text: ``empty``, ``table`` (bars), ``noise`` (marks), ``short`` or ``prose``."""
    plain = F.coalesce(F.col(text), F.lit(""))

    def count(mark: str) -> Column:
        return F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit(mark), F.lit("")))

    bars, marks = count("|"), sum((count(m) for m in MARKS[1:]), count(MARKS[0]))
    return (
        F.when(words == 0, "empty").when(bars * 10 >= words, "table").when(marks * 2 >= words, "noise").when(words < 100, "short").otherwise("prose")
    )


def fraction(key: str) -> Column:
    """A number from 0 up to 1 that depends on the id alone; a null id counts as empty."""
    digits = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 48)


def marked(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """``docs`` with its words, source, language and topic in columns called ``names``."""
    out = docs.withColumn(names["tokens"], words_in("text"))
    out = out.withColumn(names["topic"], topic_of("text", F.col(names["tokens"])))
    return out.withColumns({names[m]: F.coalesce(F.col(m).cast("string"), F.lit(MISSING)) for m in ("source", "lang")})


def even_targets(cells: DataFrame, margin: str, even: float = EVEN) -> DataFrame:
    """``margin, target``: shares in proportion to a power of each category's tokens."""
    sums = cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(even)).alias("power"))
    total = sums.agg(F.sum("power").alias("total")).first()["total"] or 1.0
    return sums.select(margin, (F.col("power") / F.lit(total)).alias("target"))


def calibrated(cells: DataFrame, targets: dict[str, DataFrame], budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (categories, ``tokens``) with ``weight``, the tokens to take from each.

    ``targets`` has per margin a table of categories and shares; categories without one get
    nothing.  Weights add up to ``budget`` of all tokens as far as the cells hold enough.
    """
    total = cells.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    goal = float(total) * budget
    state = cut(cells.filter("tokens > 0").withColumn("weight", F.col("tokens") * F.lit(budget)))
    aims = {m: cut(t.select(m, (F.col("target") * goal).alias("aim"))) for m, t in targets.items()}
    for _ in range(rounds):
        for margin, aim in aims.items():
            sums = state.df.groupBy(margin).agg(F.sum("weight").alias("have")).join(aim.small(state), margin, "left")
            factor = F.when(F.col("have") > 0, F.coalesce("aim", F.lit(0.0)) / F.col("have")).otherwise(0.0)
            scaled = state.df.join(sums.select(margin, factor.alias("factor")), margin)
            weight = F.least(F.col("weight") * F.col("factor"), F.col("tokens").cast("double"))
            state = cut(scaled.select(*MARGINS, "tokens", weight.alias("weight")), state.tiny)
    return state.df


def rates(facts: DataFrame, budget: float = BUDGET, even: float = EVEN, rounds: int = ROUNDS) -> DataFrame:
    """``source, lang, topic, probability`` of each cell of ``facts``, rounded to six places."""
    cells = cut(facts.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))).df
    targets = {m: even_targets(cells, m, even) for m in MARGINS}
    weights = calibrated(cells, targets, budget, rounds)
    return weights.select(*MARGINS, F.round(F.col("weight") / F.col("tokens"), 6).alias("probability"))


def mixed(docs: DataFrame, budget: float = BUDGET, even: float = EVEN, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, source, lang, topic, tokens, probability, sampled`` of each row.

    Null sources and languages are the category ``(none)``.  Documents without words hold no
    tokens and are never sampled (probability 0).  Rows that repeat an id share their fate;
    a null id is treated as an empty one.  An empty table gives an empty result.
    """
    names = {"tokens": "tokens", "topic": "topic", "source": "source", "lang": "lang"}
    facts = cut(marked(docs.select("doc_id", "text", "source", "lang"), names).select("doc_id", *MARGINS, "tokens")).df
    found = facts.join(rates(facts, budget, even, rounds), list(MARGINS), "left")
    chance = F.coalesce("probability", F.lit(0.0))
    return found.select("doc_id", *MARGINS, "tokens", chance.alias("probability"), (fraction("doc_id") < chance).alias("sampled"))


def mix(docs: DataFrame, budget: float = BUDGET, even: float = EVEN, rounds: int = ROUNDS) -> DataFrame:
    """The sampled rows of ``docs``, columns as they came."""
    names = {n: fresh(docs, f"_{n}") for n in ("tokens", *MARGINS)}
    rows = marked(docs, names)
    facts = rows.select(*[F.col(names[n]).alias(n) for n in ("tokens", *MARGINS)])
    rate = fresh(docs, "_rate")
    found = rates(facts, budget, even, rounds).withColumnsRenamed({**{m: names[m] for m in MARGINS}, "probability": rate})
    return rows.join(found, [names[m] for m in MARGINS]).filter(fraction("doc_id") < F.col(rate)).select(*docs.columns)


def oracle(budget: float = BUDGET, even: float = EVEN, rounds: int = ROUNDS) -> str:
    """The result of ``mixed`` with the raking rounds written out."""
    steps, before = [], "start"
    for turn in range(rounds):
        for margin in MARGINS:
            have = f"sum(weight) OVER (PARTITION BY {margin})"
            factor = f"CASE WHEN {have} > 0 THEN target * goal / {have} ELSE 0 END"
            name = f"{margin}_{turn}"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT source, lang, topic, tokens, least(weight * {factor}, CAST(tokens AS DOUBLE)) AS weight "
                f"FROM {before} JOIN aim_{margin} USING ({margin}), total)"
            )
            before = name
    aims = ", ".join(
        f"aim_{m} AS (SELECT {m}, power / sum(power) OVER () AS target FROM "
        f"(SELECT {m}, pow(CAST(sum(tokens) AS DOUBLE), {even}) AS power FROM cells GROUP BY {m}))"
        for m in MARGINS
    )
    return f"""
        WITH texts AS (
            SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '{MISSING}') AS source, coalesce(lang, '{MISSING}') AS lang,
                len([w FOR w IN string_split_regex(coalesce(text, ''), '[ \t\n\x0b\f\r]+') IF w <> '']) AS tokens
            FROM documents
        ),
        facts AS (
            SELECT doc_id, source, lang, CAST(tokens AS BIGINT) AS tokens, CASE WHEN tokens = 0 THEN 'empty'
                WHEN (length(text) - length(replace(text, '|', ''))) * 10 >= tokens THEN 'table'
                WHEN (length(text) - length(translate(text, '{MARKS}', ''))) * 2 >= tokens THEN 'noise'
                WHEN tokens < 100 THEN 'short' ELSE 'prose' END AS topic
            FROM texts
        ),
        cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM facts GROUP BY source, lang, topic),
        total AS (SELECT CAST(sum(tokens) AS DOUBLE) * {budget} AS goal FROM cells),
        {aims},
        start AS (SELECT *, tokens * CAST({budget} AS DOUBLE) AS weight FROM cells WHERE tokens > 0),
        {", ".join(steps)},
        chances AS (
            SELECT doc_id, source, lang, topic, facts.tokens AS tokens, coalesce(round(weight / c.tokens, 6), 0) AS probability
            FROM facts LEFT JOIN {before} c USING (source, lang, topic)
        )
        SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / {float(1 << 48)} < probability AS sampled
        FROM chances
    """
