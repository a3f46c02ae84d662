"""Consensus of extraction candidates, grounding in the source and the trust gate.

The candidates of a field are an array with one value for each instance (null:
the instance lacks the field), so that everything here is a row-wise expression
and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstrata.functions.text import found_in, let, plain


def _plain_values(values: Column) -> Column:
    return F.filter(F.transform(values, plain), lambda v: v.isNotNull())


def assess(values: Column) -> Column:
    """struct<value, norm, present, top, kinds, total> of a field's candidates.

    ``value`` is the most common one as first written, of ties the earliest; ``top`` how many agree with it, of ``present`` that
    have the field and ``total`` in all; ``kinds`` how many differ. Each value is normalised once.
    """
    pairs = F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.struct(v.alias("v"), plain(v).alias("n")))

    def counted(p: Column) -> Column:
        with_k = F.transform(p, lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), F.size(F.filter(p, lambda y: y["n"] == x["n"])).alias("k")))
        return let(with_k, lambda c: let(F.array_max(F.transform(c, lambda x: x["k"])), lambda top: let(F.try_element_at(F.filter(c, lambda x: x["k"] == top), F.lit(1)), lambda best: F.struct(best["v"].alias("value"), best["n"].alias("norm"), F.size(c).alias("present"), F.coalesce(top, F.lit(0)).alias("top"), F.size(F.array_distinct(F.transform(c, lambda x: x["n"]))).alias("kinds"), F.size(values).alias("total")))))

    return let(pairs, counted)


def agreement_of(a: Column) -> Column:
    """Share of the most common value among the instances that have the field; null if none has. ``a``: what ``assess`` gives."""
    return F.round(a["top"] / F.nullif(a["present"], F.lit(0)), 4)


def gate_of(a: Column, found: Column) -> Column:
    """Found in the source, and all candidates agree where there are several."""
    return found & ((a["present"] <= 1) | F.coalesce(a["top"] == a["present"], F.lit(False)))


def agreement(values: Column) -> Column:
    """Share of the most common value among the instances that have the field; null if none has."""
    return let(assess(values), agreement_of)


def majority(values: Column) -> Column:
    """The most common value as first written; of ties the earliest."""
    return assess(values)["value"]


def unanimous(values: Column) -> Column:
    """Every instance has the field and all agree."""
    norm = _plain_values(values)
    return (F.size(norm) == F.size(values)) & (F.size(F.array_distinct(norm)) == 1)


def consensus(values: Column, final: Column) -> Column:
    """Share of all instances that agree with the final value; one that lacks the field disagrees."""
    return F.round(F.size(F.filter(values, lambda v: F.coalesce(plain(v) == plain(final), F.lit(False)))) / F.size(values), 4)


def cluster_share(values: Column) -> Column:
    """Share of the largest group of equal values among all instances."""
    return let(assess(values), lambda a: F.round(a["top"] / a["total"], 4))


def trust_gate(values: Column, source: Column) -> Column:
    """Found in the source, and all candidates agree where there are several."""
    return let(assess(values), lambda a: gate_of(a, found_in(a["value"], source)))


def explanation(agree: Column, found: Column) -> Column:
    return F.when(~found, "not found in source").when(agree < 1.0, F.format_string("candidates agree in %.0f%%", agree * 100)).otherwise("grounded and agreed")


def consensus_score(ratios: Column) -> Column:
    """Aggregate: mean agreement over the fields that have several candidates (non-null ratios), null if none has."""
    return F.round(F.avg(ratios), 4)


def confidence_score(document: Column, fields: Column) -> Column:
    """Aggregate: the document's OCR score, else the mean of its fields' scores, null if there is neither."""
    return F.coalesce(F.max(document), F.round(F.avg(fields), 4))
