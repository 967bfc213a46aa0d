"""Tool calls of conversations: linked with their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.common import materialize, release
from framewise.session import scratch_path

#: name of a tool -> argument -> (SQL type of the variant, required)
SCHEMAS = {"reply": {"text": ("STRING", True), "turn": ("BIGINT", True)}}


def events_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that a conversation's turns are.

    A user turn calls the tool ``reply`` under the identifier ``conv:turn``,
    after the call two turns before it, if that is one; an assistant turn is
    the result for the turn before it. Other roles and null ones are neither; a
    turn without conversation or number has no identifier; null texts stay
    null, empty and long ones as they are; repeated rows repeat; other columns
    are ignored; no rows give no rows.
    """
    name = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    user = conversations.where(F.col("role") == "user")
    calls = user.select(
        "conv_id", "turn", F.when(known, name(0)).alias("call_id"), F.when(known, F.array(name(2))).alias("after"), F.lit("reply").alias("tool"),
        F.to_json(F.struct(F.col("turn"), F.col("text"))).alias("arguments"),
    )
    results = conversations.where(F.col("role") == "assistant").select(F.when(known, name(1)).alias("call_id"), F.col("turn").alias("at"), F.col("text").alias("content"))
    return calls, results


def argument_errors(tool: Column, arguments: Column, schemas: dict) -> Column:
    """Array of what is wrong with JSON arguments: not an object, missing, of another type, or not in the schema."""
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    keys = F.json_object_keys(arguments)
    out = F.array(F.lit("unknown tool"))
    for name, schema in sorted(schemas.items()):
        found = []
        for arg, (want, required) in sorted(schema.items()):
            got = F.schema_of_variant(F.try_variant_get(value, f"$.{arg}", "variant"))
            absent = got.isNull() | (got == "VOID")
            found.append(F.when(absent, F.lit(f"{arg}: missing") if required else F.lit(None)).when(got != want, F.lit(f"{arg}: not {want}")))
        extra = F.transform(F.array_except(keys, F.array(*map(F.lit, sorted(schema)))), lambda k: F.concat(k, F.lit(": unknown")))
        fits = F.concat(F.array_compact(F.array(*found)), F.coalesce(extra, F.array().cast("array<string>")))
        wrong = F.when(value.isNull() | ~F.startswith(kind, F.lit("OBJECT")), F.array(F.lit("not an object"))).otherwise(fits)
        out = F.when(tool == name, wrong).otherwise(out)
    return F.coalesce(out, F.array(F.lit("unknown tool")))


def canonical(json: Column) -> Column:
    """JSON with keys in order and no white space, by way of a variant; null if it can't be parsed."""
    return F.to_json(F.try_parse_json(json))


#: Links into calls after several that a task orders at a time, besides all those of a single call.
PIECE = 4096


def depths(nodes: DataFrame, session: str | None = None, order: tuple[str, ...] = ("call_id",)) -> DataFrame:
    """``call_id, depth``: the longest line of calls that come before it; null on or after a cycle. nodes: ``call_id, after`` (identifiers; others are ignored).

    Calls after one other at most form trees; these shrink by doubling, in
    rounds that grow with the logarithm of the longest line: each call gets the
    nearest call above that has none or several before it, and how far up that
    is. Calls after several are ordered by ``merge_depths``, whose rounds are
    few where most calls come after calls that precede them by ``order``
    within their ``session`` (columns of nodes); other orders only cost more
    rounds, one a layer at worst. Each round holds a row a link, so a long
    conversation is many rows and never one group.
    """
    ids = nodes.select(F.col("call_id").alias("__p"))
    hints = [F.col(session).alias("__session") if session else F.lit(0).alias("__session"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order))]
    links = materialize(nodes.select("call_id", *hints, F.explode(F.array_distinct("after")).alias("up")).join(ids, F.col("up") == F.col("__p"), "left_semi"))
    count = links.groupBy("call_id").agg(F.count("*").alias("n"), F.min("up").alias("only"))
    at = nodes.select("call_id").join(count, "call_id", "left")
    at = materialize(at.select("call_id", F.when(F.col("n") == 1, F.col("only")).alias("up"), F.when(F.col("n") == 1, F.lit(1)).otherwise(0).cast("long").alias("far"), F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("call_id")).alias("top")))
    rounds, n = 0, max(1, at.count())
    while not at.where("up IS NOT NULL").limit(1).isEmpty() and 2**rounds < 2 * n:
        above = at.select(F.col("call_id").alias("__c"), F.col("up").alias("__u"), F.col("far").alias("__f"), F.col("top").alias("__t"))
        shrunk = materialize(at.join(above, F.col("up") == F.col("__c"), "left").select("call_id", F.col("__u").alias("up"), (F.col("far") + F.coalesce("__f", F.lit(0))).alias("far"), F.coalesce("__t", "top").alias("top")))
        release(at)
        at, rounds = shrunk, rounds + 1
    # What still has a call above hangs on a cycle. Tops with none before them have depth 0; tops after several wait for all of these.
    placed = at.where("up IS NULL").select("call_id", "top", "far")
    tops = placed.where("call_id = top").select("call_id")
    roots = materialize(tops.join(links.select("call_id").distinct(), "call_id", "left_anti").select(F.col("call_id").alias("top"), F.lit(0).cast("long").alias("depth")))
    merges = links.withColumnRenamed("call_id", "merge").join(tops.withColumnRenamed("call_id", "merge"), "merge", "left_semi")
    merges = materialize(merges.join(at.select(F.col("call_id").alias("up"), "top", (F.col("far") + 1).alias("w")), "up").drop("up"))
    known = roots if merges.isEmpty() else roots.unionByName(merge_depths(merges, roots))
    found = placed.join(known, "top").select("call_id", (F.col("depth") + F.col("far")).alias("depth"))
    return nodes.select("call_id").join(found, "call_id", "left")


def merge_depths(merges: DataFrame, roots: DataFrame) -> DataFrame:
    """``top, depth`` of the calls after several that are on no cycle and after none.

    merges: a row a link, ``merge, top, w`` (``merge`` is at least ``w`` deeper
    than ``top``, which is a root, another merge or on a cycle), and the columns
    ``__session`` and ``__o0``, ``__o1``, ... that the calls are lined up by;
    roots: ``top, depth``.

    The line is cut into pieces of ``PIECE`` links, and where the session
    changes. A piece is one row, and its calls get their depths in one walk over
    it, as far as links from other pieces have arrived (a link from behind
    counts as one of those). What is new then goes over the links that leave a
    piece, and only pieces where something arrives are walked again. So a round
    writes only new depths and arrivals, each once, and rounds are as many as
    the longest path has links between pieces: a session of 10,000 calls after
    the two before each takes 5.
    """
    spark = merges.sparkSession
    line = [c for c in merges.columns if c.startswith("__")] + ["merge"]
    # Places grow along the line; all links of a call are in one partition, as ranges are of whole keys.
    linked = materialize(merges.repartitionByRange(*line).sortWithinPartitions(*line).withColumn("place", F.monotonically_increasing_id()).select("merge", "top", "w", "place", "__session"))
    chunk = Window.partitionBy(F.expr(f"place DIV {PIECE}"), "__session")  # PIECE links, and those of a call more
    spots = linked.groupBy("merge").agg(F.min("place").alias("place"), F.any_value("__session").alias("__session"))
    spots = materialize(spots.select("merge", F.min("place").over(chunk).alias("piece"), (F.row_number().over(chunk.orderBy("place")) - 1).alias("i")))
    above = spots.select(F.col("merge").alias("top"), F.col("piece").alias("__piece"), F.col("i").alias("__i"))
    given = roots.select("top", F.lit(True).alias("root"))
    edges = linked.select("merge", "top", "w").join(spots, "merge").join(above, "top", "left").join(given, "top", "left")
    inner = (F.col("__piece") == F.col("piece")) & (F.col("__i") < F.col("i"))
    kind = F.when(F.col("root"), "root").when(inner, "inner").otherwise("outer")
    edges = materialize(edges.select("merge", "piece", "i", "top", "w", F.col("__i").alias("from"), kind.alias("kind")))
    calls = edges.groupBy("piece", "i", "merge").agg(
        F.max(F.when(F.col("kind") == "root", F.col("w"))).alias("base"),
        F.count(F.when(F.col("kind") == "outer", 1)).alias("waits"),
        F.collect_list(F.when(F.col("kind") == "inner", F.struct("from", "w"))).alias("inner"),
    )
    pieces = materialize(calls.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("i", "merge", "base", "waits", "inner"))).alias("calls"), (F.sum("waits") > 0).alias("open")))
    outer = materialize(edges.where("kind = 'outer'").select("top", "piece", "i", "w"))
    opened = materialize(pieces.where("open").select("piece", "calls"))

    def walk(got: str, best: str) -> Column:
        """Depths of a piece's calls in order, null where one waits; arrivals are in the map ``came``."""

        def deeper(far: Column, call: Column) -> Column:
            came = F.try_element_at(F.col("came"), call["i"])
            start = F.when(F.coalesce(came[got], F.lit(0)) >= call["waits"], F.coalesce(F.greatest(call["base"], came[best]), F.lit(0)).cast("long"))
            inside = F.aggregate(call["inner"], start, lambda m, e: F.when(m.isNotNull() & F.get(far, e["from"]).isNotNull(), F.greatest(m, F.get(far, e["from"]) + e["w"])))
            return F.concat(far, F.array(inside))

        return F.aggregate("calls", F.array().cast("array<bigint>"), deeper)

    def solved(walked: DataFrame) -> DataFrame:
        """The calls that have a depth now and had none before."""
        each = walked.select(F.explode(F.arrays_zip(F.col("calls.merge").alias("top"), F.col("now").alias("depth"), F.col("then").alias("then"))).alias("x"))
        return each.where("x.depth IS NOT NULL AND x.then IS NULL").select("x.top", "x.depth")

    arrived, done = scratch_path(spark, "arrivals"), scratch_path(spark, "depths")
    nothing = F.create_map().cast("map<int,struct<got:bigint,best:bigint>>")
    first = pieces.withColumn("came", nothing).withColumn("now", walk("got", "best"))
    solved(first.withColumn("then", F.transform("now", lambda x: F.lit(None).cast("long")))).write.parquet(f"{done}/round=0")
    depth_schema, rounds = f"top {merges.schema['top'].dataType.simpleString()}, depth long", 0
    while True:
        fresh = spark.read.schema(depth_schema).parquet(f"{done}/round={rounds}")
        rounds += 1
        outer.join(fresh, "top").select("piece", "i", (F.col("depth") + F.col("w")).alias("far")).write.parquet(f"{arrived}/round={rounds}")
        touched = spark.read.schema("piece long, i int, far long").parquet(f"{arrived}/round={rounds}").select("piece").distinct()
        if touched.isEmpty():
            break
        every = spark.read.schema("piece long, i int, far long, round int").option("basePath", arrived).parquet(arrived).join(touched, "piece", "left_semi")
        early = F.col("round") < rounds
        came = every.groupBy("piece", "i").agg(F.count("*").alias("got"), F.max("far").alias("best"), F.count(F.when(early, 1)).alias("got_then"), F.max(F.when(early, F.col("far"))).alias("best_then"))
        came = came.groupBy("piece").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("got", "best", "got_then", "best_then")))).alias("came"))
        solved(opened.join(came, "piece").withColumn("now", walk("got", "best")).withColumn("then", walk("got_then", "best_then"))).write.parquet(f"{done}/round={rounds}")
    for table in (linked, spots, edges, pieces, outer, opened):
        release(table)
    return spark.read.schema(depth_schema).option("basePath", done).parquet(done).select("top", "depth")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict | None = None) -> DataFrame:
    """Join calls with results by identifier, order them and write each as canonical JSON.

    calls: ``conv_id, turn, call_id, after (array of identifiers), tool,
    arguments``; results: ``call_id, at, content``; other columns are ignored.
    Returns a row per call: ``conv_id``, ``turn``,
    ``call_id``, ``depth`` (a call's place in topological order: all that it
    comes after are less deep; null on a cycle), ``n_results``, ``errors``,
    ``status`` and ``json`` (arguments canonical, the earliest result, then by
    content); and a row per identifier that results name and no call has
    (status ``orphan``).

    status: ``ok``, ``no_id``, ``repeated_id`` (calls that differ), ``cycle``,
    ``invalid`` or ``no_result``, the first that holds. Repeated rows are one
    call. A null tool is an unknown one, a null ``after`` none. Null contents, empty
    and long texts and empty tables are fine.
    """
    schemas = SCHEMAS if schemas is None else schemas
    answers = results.where("call_id IS NOT NULL").groupBy("call_id").agg(F.count("*").alias("n_results"), F.min(F.struct("at", "content")).alias("first"))
    named = calls.where("call_id IS NOT NULL")
    once = materialize(
        named.groupBy("call_id").agg(
            F.lit(True).alias("is_call"),
            F.min(F.struct("conv_id", "turn", "after", "tool", "arguments")).alias("c"),
            (F.min(F.struct("conv_id", "turn", "after", "tool", "arguments")) != F.max(F.struct("conv_id", "turn", "after", "tool", "arguments"))).alias("differ"),
        ).select("call_id", "c.*", "differ", "is_call")
    )
    linked = once.join(depths(once, "conv_id", ("conv_id", "turn")), "call_id").hint("shuffle_hash").join(answers, "call_id", "full_outer")
    is_call = F.coalesce("is_call", F.lit(False))
    nameless = calls.where("call_id IS NULL").select(F.lit(None).cast("string").alias("call_id"), "conv_id", "turn", "after", "tool", "arguments", F.lit(False).alias("differ"), F.lit(True).alias("is_call"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("n_results"), F.lit(None).cast(answers.schema["first"].dataType).alias("first"))
    rows = linked.select(*nameless.columns).unionByName(nameless)
    errors = F.when(is_call, argument_errors(F.col("tool"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("errors", errors).withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    status = (
        F.when(~is_call, "orphan").when(F.col("call_id").isNull(), "no_id").when(F.col("differ"), "repeated_id").when(F.col("depth").isNull(), "cycle")
        .when(F.size("errors") > 0, "invalid").when(F.col("n_results") == 0, "no_result").otherwise("ok")
    )
    json = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("tool").alias("name"), F.try_parse_json("arguments").alias("arguments"), F.col("first.content").alias("result")))
    return rows.select("conv_id", "turn", "call_id", "depth", "n_results", "errors", status.alias("status"), canonical(json).alias("json"))
