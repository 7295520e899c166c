"""What must hold of an annotated relation: its rows, cells, the facts that support them, their witnesses and what they release."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .digest import set_digest

AT = ["row_key", "field"]


def violations(rows: DataFrame, cells: DataFrame, support: DataFrame, witness: DataFrame, releases: DataFrame, fields: dict[str, str], bundle: dict[str, str]) -> DataFrame:
    """(rule, row_key, field): every breach of a relation that is kept as tables; none if it is sound.

    * ``rows`` (row_key); ``cells`` (row_key, field, type, value, expression), a cell of each of ``fields`` (name to type) for every row;
    * ``support`` (row_key, field, fact_hash, kind, namespace, snapshot): base facts behind a cell, or behind a row where field is '';
    * ``witness`` (row_key, field, fact_hash, n): the same facts with how often they testify;
    * ``releases`` (row_key, field, fact_hash, kind, type, value, expression, commitment): the fact that a cell reveals, if any,
      either a base cell among its support, or a derived fact that is bound to its witness.

    ``bundle`` names the snapshot of each namespace. The tables meet once for each key that they
    share: all by place, support, witnesses and releases by fact, releases and cells by place. A row or cell with very many facts
    is grouped by fact, never gathered but for the digests of its witness.
    """
    known = F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])
    pinned = F.create_map(*[F.lit(x) for pair in bundle.items() for x in pair])
    out: list[DataFrame] = []

    def breach(rule: str, found: DataFrame, field: Column | str = "field") -> None:
        out.append(found.select(F.lit(rule).alias("rule"), "row_key", (F.col(field) if isinstance(field, str) else field).alias("field")))

    def breaches(found: DataFrame, rules: dict[str, Column], *more: Column) -> None:
        named = F.array_compact(F.array(*[F.when(when, F.lit(rule)) for rule, when in rules.items()]))
        out.append(found.select(F.explode(F.concat(named, *more)).alias("rule"), *AT))

    no = F.lit(0).cast("long")
    here, known_field = F.col("row_key").isNotNull() & F.col("field").isNotNull(), F.coalesce(F.col("field").isin(list(fields)), F.lit(False))
    # rows, cells, support and releases meet once by place
    names = rows.groupBy("row_key").agg(F.count("*").alias("r"))
    at = names.select("row_key", F.explode(F.array(*[F.lit(f) for f in ("", *fields)])).alias("field"), "r", no.alias("c"), no.alias("s"), no.alias("x"))
    at = at.unionByName(cells.select(*AT, no.alias("r"), F.lit(1).cast("long").alias("c"), no.alias("s"), no.alias("x")))
    at = at.unionByName(support.select(*AT, no.alias("r"), no.alias("c"), F.lit(1).cast("long").alias("s"), no.alias("x")))
    at = at.unionByName(releases.select(*AT, no.alias("r"), no.alias("c"), no.alias("s"), F.lit(1).cast("long").alias("x")))
    at = at.groupBy(*AT).agg(*[F.sum(k).alias(k) for k in ("r", "c", "s", "x")])
    r, c = F.col("r") > 0, F.col("c") > 0
    breaches(
        at,
        {
            "row twice": (F.col("field") == "") & (F.col("r") > 1),
            "cell twice": F.col("c") > 1,
            "cell without a row": c & known_field & ~(r & here),
            "unknown field": c & ~F.col("field").isin(list(fields)),
            "no cell": r & known_field & ~(c & here),
            "support of nothing": (F.col("s") > 0) & ~(here & (c | r & (F.col("field") == ""))),
            "release twice": F.col("x") > 1,
        },
    )
    breach("cell without a row", cells.where(~known_field).select(*AT).distinct().join(rows.select("row_key"), "row_key", "left_anti"))
    breach("wrong type", cells.where(F.col("type") != F.try_element_at(known, F.col("field"))))
    breach("not a base fact", support.where(~F.col("kind").isin("base-row", "base-cell") | ~F.col("fact_hash").rlike("^[0-9a-f]{64}$")))
    breach("another snapshot", support.where(~F.coalesce(F.try_element_at(pinned, F.col("namespace")) == F.col("snapshot"), F.lit(False))))
    # support, witnesses and releases of base cells meet once by fact; null keys match nothing
    none = F.lit(None).cast("long")
    facts = support.select(*AT, short_hash("fact_hash").alias("h"), F.lit(1).alias("s"), F.lit(0).alias("w"), none.alias("least"), (F.col("kind") == "base-cell").cast("int").alias("base"), F.lit(0).alias("x"))
    facts = facts.unionByName(witness.select(*AT, short_hash("fact_hash").alias("h"), F.lit(0).alias("s"), F.lit(1).alias("w"), F.col("n").alias("least"), F.lit(0).alias("base"), F.lit(0).alias("x")))
    facts = facts.unionByName(releases.where("kind = 'base-cell'").select(*AT, short_hash("fact_hash").alias("h"), F.lit(0).alias("s"), F.lit(0).alias("w"), none.alias("least"), F.lit(0).alias("base"), F.lit(1).alias("x")))
    facts = facts.groupBy(*AT, "h").agg(*[F.sum(k).alias(k) for k in ("s", "w", "base", "x")], F.min("least").alias("least"))
    s, w, met = F.col("s") > 0, F.col("w") > 0, here & F.col("h").isNotNull()
    breaches(
        facts,
        {
            "support without witness": s & ~(w & met),
            "witness without support": w & ~(s & met),
            "fact twice": (F.col("s") > 1) | (F.col("w") > 1),
            "no multiplicity": w & F.coalesce(F.col("least") < 1, F.lit(True)),
        },
        F.array_repeat(F.lit("fact twice"), (~met & (F.col("s") > 1) & (F.col("w") > 1)).cast("int")),
        F.array_repeat(F.lit("release without support"), F.when((F.coalesce("base", F.lit(0)) > 0) & met, 0).otherwise(F.col("x")).cast("int")),
    )
    revealed = releases.join(cells.select(*AT, F.col("type").alias("cell_type"), F.col("value").alias("cell_value"), F.col("expression").alias("cell_expression")), AT, "left")
    breaches(
        revealed,
        {
            "release of nothing": F.col("cell_type").isNull(),
            "release of another value": F.expr("type <> cell_type or not (value <=> cell_value)"),
            "release of another expression": F.expr("kind = 'derived' and not (expression <=> cell_expression)"),
        },
    )
    breach("release of another kind", releases.where("kind not in ('base-cell', 'derived')"))
    derived = revealed.where("kind = 'derived'").select(*AT, "commitment")
    bound = set_digest(witness.join(derived.select(*AT).distinct(), AT, "left_semi"), "fact_hash", AT, "n").select(*AT, "digest")
    breach("another commitment", derived.join(bound, AT, "left").where("not (commitment <=> digest)"))
    return reduce(DataFrame.unionByName, out)


def short_hash(text: str) -> Column:
    """The 32 bytes of a hash in hexadecimal digits; any other text as more bytes than that, so that different texts stay so."""
    return F.when((F.length(text) == 64) & F.col(text).rlike("^[0-9a-f]{64}$"), F.unhex(text)).otherwise(F.encode(F.concat(F.lit("-" * 33), F.col(text)), "UTF-8"))
