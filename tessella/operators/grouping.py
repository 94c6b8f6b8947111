"""First-fit duplicate groups at scale: a fixed point over classes of equal rows, so that no owner is ever one task.

A row joins the first group that has a member it duplicates. Groups are named by their first row, so a row's group is the
smallest row that it reaches by going from duplicate to earlier duplicate. Rows that agree in all that the rules read are a
class, and what classes agree in is a node: a URL, an owner's title at a place, an owner's title with a signature. A
class looks at its URL's node, at nodes of near-identical titles at places that fit, and at nodes of like titles with
overlapping signatures, so copies and stars cost no pairs.

A node's rows have groups that can only fall in order of time, so a node is described by its steps: from which row on it
holds which group. Rounds hand steps on: a step of a node becomes one of each class that looks at it, from that class's next
row on; a step whose group is a row that has meanwhile found a smaller group jumps there. Rounds end when no step is new.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from . import alike

#: The rules, in the order in which they are asked.
REASONS = ("same url", "same company and location, near-identical title", "same company and title, overlapping text")
TITLE, LIKE, OVERLAP = 0.92, 0.86, 0.45


def _written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _joined(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """a joined with b by sorting. Tables here are few bytes as files, where equal texts are stored once, and many as rows:
    Spark, which goes by the file's size, would gather them on the driver to broadcast them, again in each round."""
    return a.join(b.hint("merge"), on, how)


def _plain(rows: DataFrame) -> DataFrame:
    """The columns that rules read, blank for null, signatures as sorted sets."""
    w = [F.coalesce(c, F.lit("")).alias(c) for c in ("url", "owner", "title", "location")]
    sig = F.array_sort(F.array_distinct(F.filter(F.coalesce("sig", F.array().cast("array<string>")), lambda x: x.isNotNull()))).alias("sig")
    return rows.select("seq", *w, sig)


def first_fit(rows: DataFrame) -> DataFrame:
    """seq, group_seq, reason. Columns: seq (unique), url, owner, title, location, sig.

    Null counts as blank. A row without a URL and without an owner or title is a group of its own.
    """
    each = ["url", "owner", "title", "location", "sig"]
    clean = _plain(rows)
    cls = _written(clean.groupBy(*each).agg(F.min("seq").alias("cls")), "fit-classes")
    member = _written(_joined(clean, cls, each).select("seq", "cls"), "fit-members")

    titled = cls.where("owner <> '' and title <> ''")
    node = lambda df, kind, *by: df.groupBy(*by).agg(F.min("cls").alias("first")).select(*by, (F.col("first") * 4 + kind).alias("node"))
    urls, places, texts = node(cls.where("url <> ''"), 1, "url"), node(titled, 2, "owner", "title", "location"), node(titled.where(F.size("sig") > 0), 3, "owner", "title", "sig")
    in_url = _joined(cls, urls, "url").select("cls", "node")
    in_place = _joined(titled, places, ["owner", "title", "location"]).select("cls", "node")
    in_text = _joined(titled, texts, ["owner", "title", "sig"]).select("cls", "node")
    belongs = _written(in_url.unionByName(in_place).unionByName(in_text), "fit-belongs")

    found = _written(alike.pairs(titled, "owner", "title", LIKE), "fit-titles")
    equal = titled.select("owner", F.col("title").alias("text"), F.col("title").alias("other")).distinct()
    near = lambda least: alike.directed(found, "owner", least).select("owner", "text", "other").unionByName(equal)
    own, other = (places.select("owner", F.col("title").alias(t), F.col("location").alias(f"{t}_at"), F.col("node").alias(f"{t}_node")) for t in ("text", "other"))
    fits = (F.col("text_at") == "") | (F.col("other_at") == "") | (F.col("text_at") == F.col("other_at"))
    by_place = _joined(_joined(own, near(TITLE), ["owner", "text"]), other, ["owner", "other"]).where(fits).select("text_node", "other_node")
    # signatures meet at a rare token, but only those of like titles
    rare = _joined(texts, alike.rare_tokens(texts, "owner", "sig", OVERLAP), ["owner", "sig"])
    own, other = (rare.select("owner", F.col("title").alias(t), "w", F.col("sig").alias(f"{t}_sig"), F.col("node").alias(f"{t}_node")) for t in ("text", "other"))
    by_text = _joined(_joined(own, near(LIKE), ["owner", "text"]), other, ["owner", "other", "w"]).where(alike.jaccard("text_sig", "other_sig") >= OVERLAP).select("text_node", "other_node").distinct()
    looks = in_url.select("cls", "node", F.lit(0).alias("rule"))
    for k, (inside, to) in enumerate(((in_place, by_place), (in_text, by_text))):
        looks = looks.unionByName(_joined(inside, to, F.col("node") == F.col("text_node")).select("cls", F.col("other_node").alias("node"), F.lit(k + 1).alias("rule")))
    looks = _written(looks.groupBy("cls", "node").agg(F.min("rule").alias("rule")), "fit-looks")

    steps = _written(cls.select((F.col("cls") * 4).alias("node"), F.col("cls").alias("at"), F.col("cls").alias("held"), F.lit(True).alias("new")), "fit-steps")
    more = True
    while more:  # only new steps have more to hand on
        counted = Observation()
        after = _falling(steps, _round(steps.drop("new"), steps.where("new").drop("new"), member, belongs, looks))
        steps = _written(after.observe(counted, F.count_if("new").alias("n")), "fit-steps")
        more = counted.get["n"] > 0
    # a class's group from each of its steps on, and the first member of that group which it looks at
    own = steps.where("node % 4 = 0").select((F.col("node") / 4).cast("long").alias("cls"), "at", "held")
    seen = _joined(looks, steps, "node").select("cls", "held", F.col("at").alias("member_at"), "rule")
    why = _joined(own.select("cls", "held").distinct(), seen, ["cls", "held"]).groupBy("cls", "held").agg(F.min(F.struct("member_at", "rule")).alias("w")).select("cls", "held", "w.rule")
    told = _joined(own, why, ["cls", "held"], "left").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("at", "held", "rule"))).alias("steps"))
    step = F.element_at(F.filter("steps", lambda s: s["at"] <= F.col("seq")), -1)
    reason = F.element_at(F.array(*map(F.lit, REASONS)), F.col("s.rule") + 1)
    out = _joined(_joined(member, told, "cls"), belongs.select("cls").distinct().withColumn("met", F.lit(True)), "cls", "left")
    # rows that no rule can reach do not meet their equals either
    out = out.select("seq", F.when(F.col("met"), step).otherwise(F.struct(F.col("seq").alias("at"), F.col("seq").alias("held"), F.lit(None).cast("int").alias("rule"))).alias("s"))
    return out.select("seq", F.col("s.held").alias("group_seq"), F.when(F.col("s.held") == F.col("seq"), "").otherwise(reason).alias("reason"))


def _falling(steps: DataFrame, found: DataFrame) -> DataFrame:
    """Of each node the steps that lower its group, in order of time; new are those of found that are no steps yet. A node has few."""
    of = lambda df, new: df.select("node", "at", "held", F.lit(new).alias("new"))
    least = of(steps, False).unionByName(of(found, True)).repartition("node").groupBy("node", "at").agg(F.min(F.struct("held", "new")).alias("s")).select("node", "at", "s.held", "s.new")
    before = F.min("held").over(Window.partitionBy("node").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return least.withColumn("before", before).where("before is null or held < before").select("node", "at", "held", "new")


def _round(steps: DataFrame, new: DataFrame, member: DataFrame, belongs: DataFrame, looks: DataFrame) -> DataFrame:
    """Steps that follow from new ones, to the nodes a class belongs to and on to the classes that look at them; and jumps."""
    classes = lambda df: df.where("node % 4 = 0").select((F.col("node") / 4).cast("long").alias("cls"), "at", "held")
    of_class = classes(steps)
    up = _joined(belongs, classes(new), "cls").select("node", "at", "held")
    sets = of_class.groupBy("cls").agg(F.collect_list(F.struct("at", "held")).alias("own"))
    told = new.unionByName(_falling(steps, up).where("new").drop("new"))  # of what classes tell a node, few steps lower its group
    asked = _joined(_joined(looks, told, "node").select("cls", "at", "held").repartition("cls").distinct(), sets, "cls")
    asked = asked.where(~F.exists("own", lambda s: (s["at"] <= F.col("at") + 1) & (s["held"] <= F.col("held")))).select("cls", "at", "held")
    later = _joined(asked, member, (asked["cls"] == member["cls"]) & (member["seq"] > asked["at"])).groupBy(asked["cls"], asked["at"], asked["held"]).agg(F.min("seq").alias("next"))
    down = later.select((F.col("cls") * 4).alias("node"), F.col("next").alias("at"), "held")
    better = of_class.where("held < at").groupBy(F.col("at").alias("row")).agg(F.min("held").alias("to"))
    jump = _joined(steps, better, F.col("held") == F.col("row")).select("node", "at", F.col("to").alias("held"))
    return up.unionByName(down).unionByName(jump)
