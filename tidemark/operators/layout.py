"""What a log becomes when it is read through one publication or through several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.stretches import running


def transactions(lines: DataFrame) -> DataFrame:
    """Changes of a log's lines (seq, data), with tx, the seq of their BEGIN, table and kind. A transaction that no
    COMMIT has ended is not decoded yet, so its changes are left out, and so is what stands outside of any.

    Each line takes the last BEGIN before it, which is found by stretches of the log, and each COMMIT ends the one it
    follows; no task goes along the whole log.
    """
    mark = F.regexp_extract("data", "^(BEGIN|COMMIT)( |$)", 1)
    rows = lines.select("seq", "data", mark.alias("mark"))
    opened = running(rows, [], "seq", {"tx": ("last", F.when(mark == "BEGIN", F.col("seq"))), "ended": ("last", F.when(mark == "COMMIT", F.col("seq")))})
    inside = opened.where(F.col("tx").isNotNull() & ((F.col("mark") == "COMMIT") | (F.col("mark") == "")) & ~F.coalesce(F.col("ended") > F.col("tx"), F.lit(False)))
    ends = inside.where("mark = 'COMMIT'").select("tx")
    table, action = (F.regexp_extract("data", r"^table ([^:]+): (INSERT|UPDATE|DELETE|TRUNCATE):", g) for g in (1, 2))
    changes = inside.where("mark = ''").select("tx", "seq", table.alias("table"), F.lower(action).alias("kind")).where("kind <> ''")
    whole = changes.join(ends, "tx", "left_semi")
    return whole.unionByName(ends.select("tx", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("table"), F.lit("commit").alias("kind")))


def publication_frames(changes: DataFrame, publications: DataFrame) -> DataFrame:
    """Of transactions() and publications (publication, table): per publication and kind the frames that its slot sends.

    A slot sends a begin and a commit for every transaction, those without a row of its tables too, a relation when a
    table is first met, and the rows of its tables."""
    n = F.count(F.lit(1)).alias("n")
    slots = publications.select("publication").distinct()
    marks = changes.where("kind = 'commit'").agg(n).select(F.explode(F.array(F.lit("begin"), F.lit("commit"))).alias("kind"), "n")
    per_table = changes.where("kind <> 'commit'").groupBy("table", "kind").agg(n)
    rows = publications.distinct().join(per_table, "table").groupBy("publication", "kind").agg(F.sum("n").alias("n"))
    relations = publications.distinct().join(per_table.select("table").distinct(), "table").groupBy("publication").agg(n).select("publication", F.lit("relation").alias("kind"), "n")
    return slots.join(marks, F.lit(True)).select("publication", "kind", "n").where("n > 0").unionByName(rows).unionByName(relations)  # marks are two rows


def empty_transactions(changes: DataFrame, publications: DataFrame) -> DataFrame:
    """Per publication: transactions, and those of which it sends nothing but their begin and their commit."""
    met = changes.where("kind <> 'commit'").select("tx", "table").distinct().join(publications.distinct(), "table").select("publication", "tx").distinct()
    filled = met.groupBy("publication").agg(F.count(F.lit(1)).alias("filled"))
    total = changes.where("kind = 'commit'").agg(F.count(F.lit(1)).alias("transactions"))
    every = publications.select("publication").distinct().join(filled, "publication", "left").join(total, F.lit(True))  # total is one row
    return every.select("publication", "transactions", (F.col("transactions") - F.coalesce("filled", F.lit(0))).alias("empty"))


def positions(reads: DataFrame, checkpoints: DataFrame, moments: list[int]) -> DataFrame:
    """Where each slot stands at each moment (a log position): confirmed is its last read (slot, lsn) by then, and restart
    the last checkpoint (lsn) that a read has passed, 0 where there is none: reading alone doesn't let go of the log,
    and neither does a checkpoint until somebody has read past it."""
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("moment"), F.lit(m).cast("long").alias("at_lsn")) for i, m in enumerate(moments)]))
    asked = reads.select("slot").distinct().select("slot", at.alias("m")).select("slot", "m.moment", "m.at_lsn")
    both = reads.select("slot", F.lit(None).cast("int").alias("moment"), F.col("lsn").alias("at_lsn")).unionByName(asked)
    seen = running(both, ["slot"], "at_lsn", {"confirmed_lsn": ("max", F.when(F.col("moment").isNull(), F.col("at_lsn")))}, [F.col("moment").isNotNull()])
    seen = seen.where("moment is not null").withColumn("confirmed_lsn", F.coalesce("confirmed_lsn", F.lit(0)))
    marks = checkpoints.select(F.lit(None).cast("string").alias("slot"), F.lit(None).cast("int").alias("moment"), F.lit(None).cast("long").alias("at_lsn"), F.col("lsn").alias("confirmed_lsn"))
    own = running(marks.unionByName(seen), [], "confirmed_lsn", {"restart_lsn": ("max", F.when(F.col("moment").isNull(), F.col("confirmed_lsn")))}, [F.col("moment").isNotNull()])
    return own.where("moment is not null").withColumn("restart_lsn", F.coalesce("restart_lsn", F.lit(0)))


def retention(log: DataFrame, readers: DataFrame) -> DataFrame:
    """log (lsn, bytes) and readers (slot, moment, at_lsn, confirmed_lsn, restart_lsn): per slot and moment the bytes
    written by then, those after its restart position, which the server keeps for it, and those it has not confirmed.

    An as-of join: positions are lined up with the log, and each takes the bytes written up to it."""
    places = F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("lsn")) for c in ("at_lsn", "confirmed_lsn", "restart_lsn")]))
    asked = readers.select("slot", "moment", places.alias("p")).select("slot", "moment", "p.what", "p.lsn", F.lit(0).cast("long").alias("bytes"))
    rows = log.select(F.lit(None).cast("string").alias("slot"), F.lit(None).cast("int").alias("moment"), F.lit(None).cast("string").alias("what"), "lsn", F.col("bytes").cast("long").alias("bytes"))
    told = running(rows.unionByName(asked), [], "lsn", {"so_far": ("sum", F.col("bytes"))}, [F.col("what").isNotNull()]).where("what is not null")

    def up_to(what: str) -> Column:
        return F.max(F.when(F.col("what") == what, F.col("so_far")))

    out = told.groupBy("slot", "moment").agg(up_to("at_lsn").alias("written"), up_to("restart_lsn").alias("_r"), up_to("confirmed_lsn").alias("_c"))
    return out.select("slot", "moment", "written", (F.col("written") - F.col("_r")).alias("retained_bytes"), (F.col("written") - F.col("_c")).alias("unconfirmed_bytes"))
