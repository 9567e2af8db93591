"""Substring search by posting lists of three-letter grams.

A text's grams are all runs of three code points of its lower case, blanks filling up
the end.  A posting row holds, for a field, a gram and a block of ids, the ids whose text
has the gram, in order, so that even a gram that all texts share has no list longer than a
block.  A LIKE pattern is cut at its wildcards: a literal stretch of three letters or more
asks for all its grams, a shorter one for the grams that begin with it.  Only the posting
rows of these grams are read; lists are intersected block by block, and the rows that are
left are compared with the whole pattern.  A pattern without a letter leaves every row.

Postings are kept in a store by bins, each of some blocks, so a load writes the bins of the
ids that it touched and no others.

Defined results.  Null texts match nothing, empty ones only patterns of ``%``.  Ids are
distinct within a table; rows with a null id are found by no search.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plebis.sources.store import Change, Store

#: Letters of a gram, and ids of a block.
GRAM, BLOCK = 3, 1 << 18


def block_of(id: Column) -> Column:
    return F.floor(id / BLOCK).cast("long")


def bin_of(block: Column, bins: int) -> Column:
    return F.pmod(block, F.lit(bins)).cast("int")


def grams_of(text: Column) -> Column:
    padded = F.concat(F.lower(text), F.lit(" " * (GRAM - 1)))
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(F.lower(text))))
    return F.array_distinct(F.transform(places, lambda k: F.substring(padded, k, F.lit(GRAM))))


def postings(rows: DataFrame, fields: list[str], id: str = "id") -> DataFrame:
    """Rows (field, gram, block, ids) of the texts in ``fields``."""
    by_field = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), rows[f].alias("text")) for f in fields]))
    texts = rows.where(rows[id].isNotNull()).select(rows[id].cast("long").alias("id"), by_field.alias("t"))
    single = texts.select(F.col("t.field").alias("field"), F.explode(grams_of(F.col("t.text"))).alias("gram"), block_of(F.col("id")).alias("block"), "id")
    lists = single.groupBy("field", "gram", "block").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return lists.sortWithinPartitions("block", "field", "gram")


def stretches(pattern: str) -> list[str]:
    """The literal stretches of a LIKE pattern; a backslash takes the next letter as it is."""
    out, k = [""], 0
    while k < len(pattern):
        if pattern[k] in "%_":
            out.append("")
        else:
            k += pattern[k] == "\\" and k + 1 < len(pattern)
            out[-1] += pattern[k]
        k += 1
    return [s for s in out if s]


def conditions(pattern: str) -> list[tuple[str, bool]]:
    """(gram or beginning of grams, whether it is a beginning) that a match must have."""
    asked: dict[tuple[str, bool], None] = {}
    for s in stretches(pattern):
        if len(s) < GRAM:
            asked[s, True] = None
        for k in range(len(s) - GRAM + 1):
            asked[s[k : k + GRAM], False] = None
    return list(asked)


def candidates(lists: DataFrame, field: str, pattern: str) -> DataFrame | None:
    """Ids that have all grams of a lower-case pattern in a field; None where it asks for
    none."""
    asked = conditions(pattern)
    if not asked:
        return None
    gram = F.col("gram")
    meets = [F.startswith(gram, F.lit(g)) if start else gram == F.lit(g) for g, start in asked]
    read = lists.where((F.col("field") == field) & reduce(Column.__or__, meets))
    # A whole gram has one list a block; a beginning has the lists of many grams.
    found = [F.array_distinct(F.flatten(F.collect_list(F.when(m, F.col("ids"))))).alias(f"c{k}") for k, m in enumerate(meets)]
    both = reduce(F.array_intersect, [F.col(f"c{k}") for k in range(len(meets))])
    return read.groupBy("block").agg(*found).select(F.explode(both).alias("id"))


@dataclass
class Index:
    """The posting lists of some tables, as the newest version of a store has them.  An
    index keeps the number of bins that it was built with."""

    store: Store
    bins: int = 16

    def _change(self, rows: DataFrame, fields: list[str], id: str, parts: list[int] | None = None) -> Change:
        return Change(postings(rows, fields, id).withColumn("bin", bin_of(F.col("block"), self.bins)), "bin", parts)

    def build(self, table: str, rows: DataFrame, fields: list[str], id: str = "id") -> Index:
        self.store.commit({f"grams_{table}": self._change(rows, fields, id)})
        return self

    def refresh(self, table: str, rows: DataFrame, fields: list[str], touched: DataFrame, id: str = "id") -> Index:
        """After a load: ``rows`` is the table as it is now, ``touched`` the ids that came,
        went or changed.  Only their bins are read and written."""
        own = lambda df: bin_of(block_of(df[id]), self.bins)
        parts = sorted(r[0] for r in touched.select(own(touched).alias("b")).where("b is not null").distinct().collect())
        self.store.commit({f"grams_{table}": self._change(rows.where(own(rows).isin(parts)), fields, id, parts)})
        return self

    def narrow(self, table: str, rows: DataFrame, fields: list[str], pattern: Column, id: str = "id") -> DataFrame:
        """The rows that have ``pattern``, an expression of literals, in one of the fields,
        as ILIKE has it; the plan reads their posting lists first."""
        lower = self.store.spark.sql("SELECT 1").select(F.lower(pattern)).first()[0]
        matches = reduce(Column.__or__, [F.ilike(rows[f], pattern) for f in fields])
        lists = self.store.read(f"grams_{table}")
        found = [candidates(lists, f, lower) for f in fields]
        if any(c is None for c in found):
            return rows.where(matches)
        ids = reduce(DataFrame.unionByName, found).select(F.col("id").alias("__found"))
        return rows.where(matches).join(ids, rows[id] == F.col("__found"), "left_semi")
