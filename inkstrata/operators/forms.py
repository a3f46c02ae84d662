"""Form filling plans: which value goes where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.functions.text import key

MIN_CONFIDENCE = 0.6
RULES = ("map", "alias", "normalized alias", "name", "normalized name")


def match(fields: DataFrame, targets: DataFrame) -> DataFrame:
    """The best target of each data field: explicit map, alias, alias as key, name, name as key, in this order.

    ``fields``: field, mapped, aliases (array, by rank). ``targets``: target. All
    rules are equi-joins on (rule, key), made as one join of exploded keys.
    """
    alias = F.col("aliases")
    entry = lambda rank, exact, v: F.struct(F.lit(rank).alias("rank"), F.lit(exact).alias("exact"), v.alias("k"))
    many = lambda rank, exact, f: F.transform(alias, lambda a: entry(rank, exact, f(a)))
    wanted = F.flatten(F.array(F.array(entry(0, True, F.col("mapped"))), many(1, True, lambda a: a), many(2, False, key), F.array(entry(3, True, F.col("field"))), F.array(entry(4, False, key(F.col("field"))))))
    want = fields.select("field", F.posexplode(wanted).alias("pos", "w")).select("field", "pos", "w.*").where(F.col("k").isNotNull() & (F.col("k") != ""))
    have = targets.select("target", F.explode(F.array(F.struct(F.lit(True).alias("exact"), F.col("target").alias("k")), F.struct(F.lit(False).alias("exact"), key(F.col("target")).alias("k")))).alias("h")).select("target", "h.*")
    best = want.join(have, ["exact", "k"]).groupBy("field").agg(F.min(F.struct("rank", "pos", "target")).alias("b"))
    return fields.join(best, "field", "left").select("field", F.col("b.target").alias("target"), F.when(F.col("b").isNotNull(), F.element_at(F.array(*[F.lit(r) for r in RULES]), F.col("b.rank") + 1)).alias("rule"))


def blank_labels(words: DataFrame, blanks: DataFrame, keys: list[str], n: int = 6) -> DataFrame:
    """Label of each blank: the last ``n`` words to its left on its line."""
    left = blanks.join(words, keys).where(F.col("x1") <= F.col("blank_x0"))
    w = Window.partitionBy(*keys, "blank").orderBy(F.desc("x1"), F.desc("word"))
    near = left.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    return near.groupBy(*keys, "blank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("o"), "text"))), lambda x: x["text"]), " ").alias("label"))


def review(placements: DataFrame) -> DataFrame:
    """Why a placement should be looked at: no target, little confidence, found automatically."""
    reasons = F.filter(F.array(F.when(F.col("target").isNull(), "unmapped"), F.when(F.col("confidence") < MIN_CONFIDENCE, "low confidence"), F.when(F.col("method") == "auto", "found automatically")), lambda x: x.isNotNull())
    return placements.withColumn("reasons", reasons)


def format_value(value: Column, template: str) -> Column:
    """The value put into a template with one ``{}``."""
    before, _, after = template.partition("{}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def assign_blanks(scores: DataFrame, threshold: float = MIN_CONFIDENCE) -> DataFrame:
    """Greedy one-to-one mapping of each document's fields to blanks, best score first, earlier on ties.

    ``scores``: doc_id, field_pos, blank_pos, score. Sequential by nature, so it runs for each document in one group.
    """
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for field, own in rows.sort_values(["field_pos", "blank_pos"]).groupby("field_pos", sort=True):
            best = None
            for _, r in own.iterrows():
                if r.blank_pos not in taken and r.score >= threshold and (best is None or r.score > best.score):
                    best = r
            if best is not None:
                taken.add(best.blank_pos)
                out.append((rows.doc_id.iloc[0], field, best.blank_pos, best.score))
        return pd.DataFrame(out, columns=["doc_id", "field_pos", "blank_pos", "score"]).astype({"doc_id": "int64", "field_pos": "int32", "blank_pos": "int32", "score": "float64"})

    return scores.groupBy("doc_id").applyInPandas(run, "doc_id bigint, field_pos int, blank_pos int, score double")
