"""Graphs of nodes: topological levels and ancestors, a round of joins per level; runs of workflows, a round per step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalar import render, with_blanks
from .shared import cut as _cut
from .shared import saved, shared_path


#: Levels after which edges that are done with are left out of what is read.
_TIDY = 8


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and level of nodes (id): 0 without an edge (src, dst) into it, else one over the highest of its sources. Nodes on a cycle or behind one are left out, and edges from or to unknown nodes don't count.

    A level is one job, which looks at the targets of the level before; levels that are found aren't read again but for
    leaving out their edges. Joins are merged: files of ids are far smaller than their rows, and a side that looks small
    enough to broadcast would go through the driver in every job.
    """
    spark, path, level = nodes.sparkSession, shared_path(nodes.sparkSession, "levels"), 0
    e = edges.join(nodes.select(F.col("id").alias("src")).hint("merge"), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")).hint("merge"), "dst", "left_semi").distinct()
    e = saved(e.select("src", "dst"), "edges")
    schema = nodes.select("id", F.lit(0).cast("long").alias("level")).schema
    at = lambda first, last: spark.read.schema(schema).parquet(*[f"{path}/{i}" for i in range(first, last + 1)])
    found, tidy = nodes.select("id").distinct().join(e.select(F.col("dst").alias("id")).hint("merge"), "id", "left_anti"), 0
    while True:
        seen = Observation()
        found.select("id", F.lit(level).cast("long").alias("level")).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/{level}")
        if not seen.get["n"]:
            return at(0, level)
        here = at(level, level).select(F.col("id").alias("src"))
        left = e.join(at(tidy, level).select(F.col("id").alias("src")).hint("merge"), "src", "left_anti")
        reached = e.join(here.hint("merge"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        if level - tidy + 1 >= _TIDY:
            reached, left, tidy = saved(reached, "reached"), saved(left, "edges"), level + 1
            e = left
        found = reached.join(left.select(F.col("dst").alias("id")).hint("merge"), "id", "left_anti")
        level += 1


def ancestors(nodes: DataFrame) -> DataFrame:
    """id, root and depth of nodes (id, parent): root is the first ancestor whose parent isn't there. Nodes on a cycle have none. Pointers double in length each round."""
    known = nodes.select(F.col("id").alias("parent"))
    has = nodes.join(known, "parent", "left_semi").select("id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"))
    top = nodes.join(known, "parent", "left_anti").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"))
    done, open_ = _cut(top), _cut(has)
    # After r rounds a pointer spans 2 ** r steps; one that is open when that exceeds the number of nodes goes round a cycle.
    for _ in range(nodes.count().bit_length() + 1):
        if open_.isEmpty():
            break
        far = done.select(F.col("id").alias("up"), "root", F.col("depth").alias("more"))
        new = open_.join(far, "up").select("id", "root", (F.col("depth") + F.col("more")).alias("depth"))
        hop = open_.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        rest = open_.join(far, "up", "left_anti").join(hop, "up").select("id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        done, open_ = _cut(done.unionByName(new)), _cut(rest)
    return done


#: What a run does at a node of each kind; the handle is that of the edges which it leaves by.
KINDS = ("start", "end", "condition", "loop", "variable", "knowledge")
TESTS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "contains": F.contains, "<": lambda a, b: a.cast("double") < b.cast("double"), ">": lambda a, b: a.cast("double") > b.cast("double")}


def executed(runs: DataFrame, nodes: DataFrame, edges: DataFrame, retrieve=None, max_steps: int = 100) -> DataFrame:
    """run_id, node, vars, steps, status and error of runs (run_id, vars map<string,string>) through one workflow, where each path of a run ended.

    nodes: id, kind, name, test, value (null where a kind has none of these); edges: src, dst, handle (blank unless
    its node has several ways out). All runs take a step together, and each step is a few joins:

    - condition: leaves by `true` or `false`: the variable `name` against `value` by `test` (one of TESTS); null is false;
    - loop: leaves by `body` as often as `value` says (a number, or {{variable}}), then by `done`; entered again it begins anew;
    - variable: `name` becomes `value`, in which {{variables}} are replaced;
    - knowledge: `name` becomes what retrieve(questions: query_id, question) -> query_id, context finds for `value`, blank for nothing;
    - start goes on; end, and a node without a way out, ends with status success.

    A run at a node of another kind, in a loop whose count isn't a number, or still on its way after max_steps, fails
    with an error, and its vars are those it had. Paths of one run don't wait for each other. A retrieve call per step
    serves all runs that are at such a node.
    """
    spark = runs.sparkSession
    n = nodes.select(F.col("id").alias("node"), "kind", "name", "test", F.col("value").alias("config"))
    e = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.coalesce("handle", F.lit("")).alias("handle"))
    start = n.filter("kind = 'start'").select("node")
    path = shared_path(spark, "runs")
    at = _cut(runs.select("run_id", F.coalesce("vars", F.create_map().cast("map<string,string>")).alias("vars")).crossJoin(F.broadcast(start)).withColumn("counts", F.create_map().cast("map<string,int>")))  # a workflow has a start node or two
    out = ["run_id", "node", "vars", "steps", "status", "error"]
    schema = at.select("run_id", "node", "vars", F.lit(0).alias("steps"), F.lit("").alias("status"), F.lit("").alias("error")).schema
    spark.createDataFrame([], schema).write.parquet(path)
    for step in range(max_steps + 1):
        if at.isEmpty():
            break
        t = at.join(n, "node", "left")
        filled = render(F.col("config"), F.transform(F.map_entries(with_blanks(F.col("config"), F.col("vars"))), lambda v: F.struct(v["key"].alias("k"), v["value"].alias("v"))))
        own = F.col("node").cast("string")
        done, limit = F.coalesce(F.element_at("counts", own), F.lit(0)), F.expr("try_cast(filled as int)")
        tested = F.coalesce(*[F.when(F.col("test") == k, f(F.element_at("vars", F.col("name")), F.col("filled"))) for k, f in TESTS.items()], F.lit(False))
        error = F.when(F.coalesce(~F.col("kind").isin(*KINDS), F.lit(True)), F.concat(F.lit("unsupported node type: "), F.coalesce("kind", F.lit("none")))).when((F.col("kind") == "loop") & limit.isNull(), F.concat(F.lit("not a count: "), F.coalesce("filled", F.lit(""))))
        handle = F.when(F.col("kind") == "condition", tested.cast("string")).when(F.col("kind") == "loop", F.when(done < limit, "body").otherwise("done")).otherwise("")
        without = lambda m, k: F.map_filter(m, lambda x, _: x != k)
        counts = F.when((F.col("kind") == "loop") & (done < limit), F.map_concat(without("counts", own), F.create_map(own, done + 1))).when(F.col("kind") == "loop", without("counts", own)).otherwise(F.col("counts"))
        t = t.withColumn("filled", filled).withColumn("error", error).withColumn("handle", handle).withColumn("counts", counts).withColumn("place", F.monotonically_increasing_id())
        t = saved(t, "steps")
        value = F.when(F.col("kind") == "variable", F.coalesce("filled", F.lit("")))
        asked = t.filter("kind = 'knowledge' and error is null").select(F.col("place").alias("query_id"), F.col("filled").alias("question"))
        if not asked.isEmpty():
            if retrieve is None:
                raise ValueError("a workflow with knowledge nodes needs retrieve")
            found = retrieve(asked).select(F.col("query_id").alias("place"), "context")
            t = t.join(found, "place", "left")
            value = value.when(F.col("kind") == "knowledge", F.coalesce("context", F.lit("")))
        t = t.withColumn("set", value).withColumn("vars", F.when(F.col("set").isNotNull(), F.map_concat(without("vars", F.col("name")), F.create_map(F.coalesce("name", F.lit("")), F.col("set")))).otherwise(F.col("vars")))
        ways = t.join(e, ["node", "handle"], "left").withColumn("error", F.coalesce("error", F.when(F.lit(step == max_steps) & F.col("next").isNotNull() & (F.col("kind") != "end"), F.lit(f"over {max_steps} steps"))))
        over = (F.col("kind") == "end") | F.col("next").isNull() | F.col("error").isNotNull()
        ways = _cut(ways.select("run_id", "node", "vars", "counts", "next", "error", F.coalesce(over, F.lit(True)).alias("over")))
        ways.filter("over").withColumn("steps", F.lit(step)).withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("failed")).select(*out).write.mode("append").parquet(path)
        at = ways.filter("not over").select("run_id", F.col("next").alias("node"), "vars", "counts")
    return spark.read.schema(schema).parquet(path)
