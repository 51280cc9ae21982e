"""M1 with M3 over time: registrations and deletions in one log, where a deletion frees an admission number.

A registration owns its number from its position in the log to the first later deletion of its student, if it is
accepted; it is accepted if nobody owns the number then. So the accepted ones of a number form a chain: the first that
comes after the table's owners are gone, then the first that comes after that one's deletion, and so on. Each
registration's successor in such a chain does not depend on what is accepted, only on positions. Successors are found
for all registrations at once, by a sorted pass, and the chains are followed by doubling the steps, in a number of
rounds logarithmic in the longest chain. No number's commands are gathered in one task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bursar.functions.formats import ACTIVE, is_php_empty, php_trim, text_key
from bursar.operators.changes import POSITION, _reason, _split
from bursar.operators.numbering import numbered
from bursar.operators.staging import staged
from bursar.sources import schemas
from bursar.sources.tables import conform

cloudpickle.register_pickle_by_value(sys.modules[__name__])

REGISTER, DELETE = "register", "delete"
_FOUND = "key string, at long, asks boolean, part int, next long"


@dataclass
class StudentLogResult:
    table: DataFrame    # the students after the log
    rejects: DataFrame  # seq, action, student_id, admission_number, reject_reason
    added: DataFrame    # students registered and still there
    deleted: DataFrame  # student_id of everyone deleted: their payments, discounts and issues go with them


def _next_in_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each row of a sorted partition the next position of the same key that does not ask, if it lies in here."""
    frames = [b for b in batches if len(b)]
    if not frames:
        return
    pdf = pd.concat(frames, ignore_index=True).sort_values(["key", "at", "asks"], kind="stable").reset_index(drop=True)
    offered = pdf["at"].where(~pdf["asks"].astype(bool)).astype("Int64")
    # The first offer below each row: filled backwards within the key, and not the row itself.
    later = offered.groupby(pdf["key"], sort=False).shift(-1)
    pdf["next"] = later.groupby(pdf["key"], sort=False).bfill()
    yield pdf.assign(part=TaskContext.get().partitionId())[["key", "at", "asks", "part", "next"]]


def following(offers: DataFrame, asked: DataFrame) -> DataFrame:
    """key, at, next for each row of ``asked`` (key, at): the least ``at`` of ``offers`` (key, at) of that key that is larger.

    Both are range-partitioned together by key and position. What a partition cannot see, as its last key goes on in the next
    ones, is handed back over one row per partition. Rows without a larger offer have a null.
    """
    both = (offers.select("key", "at", F.lit(False).alias("asks")).unionByName(asked.select("key", "at", F.lit(True).alias("asks"))))
    # Of equal positions the offer sorts first, so it does not follow itself.
    found = staged(both.repartitionByRange("key", "at").mapInPandas(_next_in_partition, _FOUND))
    firsts = (found.groupBy("part").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))
              .join(found.filter(~F.col("asks")).groupBy("part", "key").agg(F.min("at").alias("offer"))
                    .select("part", F.col("key").alias("first_key"), "offer"), ["part", "first_key"], "left"))
    # A key that fills partitions: the first offer of that key in any partition after this one.
    key_run = Window.partitionBy("first_key").orderBy("part").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    by_part = Window.orderBy("part")  # one row per partition
    ahead = (firsts.withColumn("offer_from", F.min("offer").over(key_run))
             .select("part", F.col("last_key").alias("key"), F.lead("first_key").over(by_part).alias("after"),
                     F.lead("offer_from").over(by_part).alias("carried"))
             .filter("after = key").select("part", "key", "carried"))
    return (found.filter("asks").join(staged(ahead), ["part", "key"], "left")
            .select("key", "at", F.coalesce("next", "carried").alias("next")))


def reachable(steps: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes that the ``roots`` (node) reach over ``steps`` (node, next), each with one step at most, roots included.

    Round k adds what lies 2^k steps further on, by two joins on unique nodes.
    """
    reached, jump = staged(roots.distinct()), staged(steps.filter("next is not null"))
    while True:
        more = reached.join(jump, "node").select(F.col("next").alias("node"))
        grown = staged(reached.union(more).distinct())
        if grown.count() == reached.count():
            return grown
        reached = grown
        jump = staged(jump.alias("a").join(jump.select(F.col("node").alias("next"), F.col("next").alias("beyond")), "next")
                      .select("node", F.col("beyond").alias("next")))


def apply_student_log(students: DataFrame, log: DataFrame) -> StudentLogResult:
    """The students after a log of ``register`` and ``delete`` commands in order.

    Rules as in M1 and M3: a registration needs a number, a name and a class, and a number that no student has at that
    moment (letter case aside). New students get the table's largest key plus their position in the log, so a later
    command can name them. Deleting someone who is not there at that moment, or not yet, is reported as unknown. A number that
    several students of the table share is free once all of them are gone.
    """
    c = numbered(conform(log, schemas.STUDENT_LOG), ["seq"], POSITION)
    c = c.withColumns({k: php_trim(k) for k in ("admission_number", "full_name", "guardian_name", "guardian_phone")})
    action, at = F.col("action"), F.col(POSITION)
    missing = is_php_empty("admission_number") | is_php_empty("full_name") | is_php_empty("class_id")
    valid, bad = _split(c, _reason((~F.coalesce(action.isin(REGISTER, DELETE), F.lit(False)), "unknown_action"),
                                   ((action == REGISTER) & missing, "missing_fields")))
    top = students.agg(F.coalesce(F.max("student_id"), F.lit(0)).cast("bigint")).scalar()
    asked = staged(valid.filter(action == REGISTER).withColumn("student_id", top + at).withColumn("key", text_key("admission_number")))
    deletes = staged(valid.filter(action == DELETE).select("seq", POSITION, "student_id"))

    # When each is deleted, if accepted: the first deletion after its registration (the table's: the first of all).
    born = asked.select("student_id", at.alias("born"))
    ends = staged(deletes.join(born, "student_id", "left").filter("born is null or _pos > born")
                  .groupBy("student_id").agg(F.min(POSITION).alias("end")))
    wanted = staged(asked.select("key").distinct())
    owners = (students.select("student_id", text_key("admission_number").alias("key")).join(wanted, "key", "left_semi")
              .join(ends, "student_id", "left").groupBy("key")
              .agg(F.max("end").alias("end"), F.bool_or(F.col("end").isNull()).alias("stays")))
    free = (wanted.join(owners, "key", "left").filter(~F.coalesce("stays", F.lit(False)))
            .select("key", F.coalesce("end", F.lit(0).cast("bigint")).alias("at")))
    lives = staged(asked.select("key", "student_id", at.alias("node")).join(ends, "student_id", "left"))
    offers = asked.select("key", at.alias("at"))
    probes = lives.filter("end is not null").select("key", F.col("end").alias("at"), "node")
    found = staged(following(offers, probes.select("key", "at").union(free).distinct()))
    steps = probes.join(found, ["key", "at"]).select("node", "next")
    roots = free.join(found, ["key", "at"]).filter("next is not null").select(F.col("next").alias("node"))
    accepted = reachable(steps, roots).select(F.col("node").alias(POSITION))

    new = staged(asked.join(accepted, POSITION, "left_semi"))
    added = (conform(new.join(ends, "student_id", "left_anti")
                     .withColumns({"is_boarder": F.coalesce(F.col("is_boarder"), F.lit(0)), "status": F.lit(ACTIVE)}), schemas.STUDENTS))
    # A deletion counts if it is the first one of a student who is in the table or was accepted.
    known = staged(students.select("student_id").join(staged(deletes.select("student_id").distinct()), "student_id", "left_semi")
                   .union(new.select("student_id")))
    effective = staged(ends.join(known, "student_id", "left_semi"))
    idle = deletes.join(effective.select("student_id", F.col("end").alias(POSITION)), ["student_id", POSITION], "left_anti")
    refused = asked.join(accepted, POSITION, "left_anti")
    no_number = F.lit(None).cast("string").alias("admission_number")
    rejects = (bad.select("seq", "action", "student_id", "admission_number", "reject_reason")
               .unionByName(refused.select("seq", "action", F.lit(None).cast("bigint").alias("student_id"), "admission_number",
                                           F.lit("admission_exists").alias("reject_reason")))
               .unionByName(idle.select("seq", F.lit(DELETE).alias("action"), "student_id", no_number,
                                        F.lit("unknown_student").alias("reject_reason"))))
    gone = effective.select("student_id")
    return StudentLogResult(students.join(gone, "student_id", "left_anti").unionByName(added), rejects, added, gone)
