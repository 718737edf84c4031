"""Alternative readings: order by certainty, payloads, sorted features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import escape_value


def _alternatives(c: Column) -> Column:
    return F.split(c, r"\|")


def _single(c: Column) -> Column:
    """Whether a cell has one reading, as most have: then there is nothing to split, order or count."""
    return ~c.contains("|")


def certainties(misc: Column) -> Column:
    """The numbers of a cell of alternatives, others left out."""
    return F.filter(F.transform(F.filter(_alternatives(misc), lambda x: ~x.startswith("Offset=")), lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def _ordered(values: Column, numbers: Column) -> Column:
    """Structs (minus certainty, place, value), highest certainty first, ties in place."""
    return F.sort_array(F.transform(values, lambda v, i: F.struct((-F.get(numbers, i)).alias("p"), i.alias("i"), v.alias("v"))))


def sorted_pos(xpos: Column, misc: Column) -> Column:
    """Readings by falling certainty, if there are as many numbers as readings; else as they are."""
    v, n = _alternatives(xpos), certainties(misc)
    return F.when(_single(xpos), xpos).when(F.size(v) == F.size(n), F.array_join(F.transform(_ordered(v, n), lambda x: x["v"]), "|")).otherwise(xpos)


def sorted_misc(xpos: Column, misc: Column) -> Column:
    """The certainties in the readings' new order, to three places."""
    v, n = _alternatives(xpos), certainties(misc)
    return F.when(F.size(v) == F.size(n), F.array_join(F.transform(_ordered(v, n), lambda x: F.format_string("%.3f", -x["p"])), "|")).otherwise(misc)


def sorted_lemma(lemma: Column, xpos: Column, misc: Column) -> Column:
    """Distinct lemmas; by falling certainty if lemmas, readings and numbers are equally many."""
    v, n = F.array_distinct(_alternatives(lemma)), certainties(misc)
    same = (F.size(v) == F.size(n)) & (F.size(_alternatives(xpos)) == F.size(n))
    return F.when(_single(lemma), lemma).when(same, F.array_join(F.transform(_ordered(v, n), lambda x: x["v"]), "|")).otherwise(F.array_join(v, "|"))


def payloads(prefix: Column, xpos: Column, misc: Column) -> Column:
    """``prefix/p:X`` for each reading, with its certainty as a byte where several readings have one."""
    v, parts = _alternatives(xpos), _alternatives(misc)
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    every = (F.size(parts) == F.size(v)) & ~F.exists(numbers, lambda x: x.isNull())
    rows = F.when(every, _ordered(v, numbers)).otherwise(F.transform(v, lambda x, i: F.struct((-F.get(numbers, i)).alias("p"), i.alias("i"), x.alias("v"))))
    plain = F.array(F.concat(prefix, F.lit("/p:"), escape_value(xpos)))
    one = lambda x: F.concat(prefix, F.lit("/p:"), escape_value(x["v"]), F.when(x["p"].isNotNull() & (F.size(v) > 1), F.concat(F.lit("$<b>129<b>"), F.rint(-x["p"] * 255).cast("int").cast("string"))).otherwise(""))
    return F.when(_single(xpos), plain).otherwise(F.transform(rows, one))


def features(prefix: Column, feats: Column) -> Column:
    """``prefix/m:key:value`` in lower case, sorted; items without exactly one = are left out."""
    parts = F.filter(F.transform(_alternatives(feats), lambda x: F.split(x, "=")), lambda x: F.size(x) == 2)
    return F.sort_array(F.transform(parts, lambda x: F.concat(prefix, F.lit("/m:"), escape_value(F.lower(x[0])), F.lit(":"), escape_value(F.lower(x[1])))))
