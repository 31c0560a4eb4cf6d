"""Linking: observations (flat facts of parsers) become nodes and typed edges with evidence.

Everything is equi-joins on aggregated key tables: a name resolves if one key table has exactly one
node for it. The order of observations is (file_path, ord); it decides which of several definitions
counts (the last), the order of evidence, and which imports a call can see (earlier ones).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeingraph.functions.columns import dotted_suffixes, last_part, module_scope, normal_symbol, stable_id
from skeingraph.functions.schemas import DEFINITION_KINDS, EDGE, EVIDENCE, NODE, NODE_KINDS
from skeingraph.runtime import stored

CONFIDENCE = {"CONTAINS": 1.0, "DEFINES": 1.0, "IMPORTS": 0.9, "INHERITS": 0.95, "CALLS": 0.85, "MAY_CALL": 0.45}


def only(key: str = "node_id") -> tuple[Column, Column]:
    return F.min(key).alias("low"), F.max(key).alias("high")


def last_wins(rows: DataFrame, keys: list[str], values: list[str], order: str, *more: Column) -> DataFrame:
    """For each key the values of its last row in the order, and further aggregates."""
    grouped = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("__last"), *more)
    return grouped.select(*keys, "__last.*", *grouped.columns[len(keys) + 1 :])


def prepared(observations: DataFrame) -> DataFrame:
    """Observations with language, node id, the whole digest that its digits are from, place in order
    and the prefix of evidence types."""
    parser = F.coalesce("raw.parser", F.lit("syntax"))
    whole = stable_id("", F.col("repo_id"), F.col("kind"), F.col("fqname"), F.col("file_path"), length=40)
    return observations.withColumns({
        "language": F.coalesce("raw.language", F.lit("python")),
        "parser": parser,
        "prefix": F.when(parser == "python_ast", "ast").otherwise(parser),
        "seq": F.struct("file_path", "ord"),
        "node_id": F.concat(F.lit("node"), F.substring(whole, 1, 13)),
        "identity": F.unhex(F.substring(whole, 2, 40)),
    })


def repository_id(repo_id: Column) -> Column:
    return stable_id("node", repo_id, F.lit("repository"))


def exact_parents(defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names that stand for one node: by (fqname, language, file), where every observation counts,
    and by (fqname, language), where every node counts."""
    in_file = defs.groupBy("fqname", "language", "file_path").agg(F.count("*").alias("n"), F.min("node_id").alias("in_file")).where("n = 1").drop("n")
    anywhere = defs.groupBy("fqname", "language").agg(*only()).where("low = high").select("fqname", "language", F.col("low").alias("anywhere"))
    return in_file, anywhere


def with_parent(rows: DataFrame, defs: DataFrame, name: str, out: str) -> DataFrame:
    """Adds out: the node that `name` stands for, seen from the row's file and language, or null."""
    in_file, anywhere = exact_parents(defs)
    in_file = in_file.select(F.col("fqname").alias("__n1"), F.col("language").alias("__l1"), F.col("file_path").alias("__f1"), "in_file")
    anywhere = anywhere.select(F.col("fqname").alias("__n2"), F.col("language").alias("__l2"), "anywhere")
    rows = rows.join(in_file, (F.col(name) == F.col("__n1")) & (F.col("language") == F.col("__l1")) & F.col("file_path").eqNullSafe(F.col("__f1")), "left")
    rows = rows.join(anywhere, (F.col(name) == F.col("__n2")) & (F.col("language") == F.col("__l2")), "left")
    return rows.withColumn(out, F.coalesce("in_file", "anywhere")).drop("__n1", "__l1", "__f1", "in_file", "__n2", "__l2", "anywhere")


def symbol_tables(defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(language, key) -> the only node whose name is the key, else the only one that ends with it;
    (language, short name) -> the only node of that name."""
    suffixes = defs.select("language", "fqname", "node_id", F.explode(dotted_suffixes(F.col("fqname"))).alias("key"))
    whole = F.when(F.col("key") == F.col("fqname"), F.col("node_id"))
    by_name = suffixes.groupBy("language", "key").agg(F.min(whole).alias("a"), F.max(whole).alias("b"), *only())
    by_name = by_name.select("language", "key", F.coalesce(F.when(F.col("a") == F.col("b"), F.col("a")), F.when(F.col("low") == F.col("high"), F.col("low"))).alias("named")).where("named IS NOT NULL")
    short = defs.groupBy("language", F.col("name").alias("key")).agg(*only()).where("low = high").select("language", "key", F.col("low").alias("short"))
    return by_name, short


def with_symbol(rows: DataFrame, defs: DataFrame, name: str, out: str) -> DataFrame:
    """Adds out: the node that the symbol in `name` resolves to, by whole name, dotted suffix or
    short name, each only if unique in the language; null or empty names resolve to nothing."""
    by_name, short = symbol_tables(defs)
    rows = rows.withColumn("__key", F.when(F.col(name) != "", normal_symbol(F.col(name)))).withColumn("__last", last_part(F.col("__key")))
    by_name = by_name.select(F.col("language").alias("__l1"), F.col("key").alias("__k1"), "named")
    short = short.select(F.col("language").alias("__l2"), F.col("key").alias("__k2"), "short")
    rows = rows.join(by_name, (F.col("language") == F.col("__l1")) & (F.col("__key") == F.col("__k1")), "left")
    rows = rows.join(short, (F.col("language") == F.col("__l2")) & (F.col("__last") == F.col("__k2")), "left")
    return rows.withColumn(out, F.coalesce("named", "short")).drop("__key", "__last", "__l1", "__k1", "__l2", "__k2", "named", "short")


def latest_alias(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """Adds alias to calls (language, module, head, seq, ...): the target of the last import of that
    name into the module that comes before the call. One sort for each (language, module, head)."""
    sides = calls.withColumn("__target", F.lit(None).cast("string")).unionByName(imports.select("language", "module", "head", "seq", F.col("target").alias("__target")), allowMissingColumns=True)
    w = Window.partitionBy("language", "module", "head").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return sides.withColumn("alias", F.last("__target", ignorenulls=True).over(w)).where("__is_call").drop("__target")


def rebound(target: Column, class_fqname: Column, alias: Column) -> Column:
    """A call's target with self, cls or this replaced by the enclosing class, else its head by its alias."""
    rest = F.regexp_extract(target, r"(?s)^[^.]*\.(.*)$", 1)
    own = (F.coalesce(class_fqname, F.lit("")) != "") & target.rlike(r"^(self|cls|this)\.")
    tail = F.regexp_extract(target, r"(?s)^[^.]*(.*)$", 1)
    return F.when(own, F.concat(class_fqname, F.lit("."), rest)).when(alias.isNotNull(), F.concat(alias, tail)).otherwise(target)


def evidence(kind: Column, span: Column) -> Column:
    return F.struct(kind.alias("type"), F.col("file_path"), span.alias("span"), F.expr("cast(map() as map<string,string>)").alias("data")).cast(EVIDENCE)


def confidence_of(rel: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv)), rel)


def merged_edges(rows: DataFrame, now: Column) -> DataFrame:
    """Edge rows (src, dst, rel, seq, evidence, repo_id) -> one edge for each (src, dst, rel)."""
    e = rows.groupBy("src", "dst", "rel").agg(F.count("*").alias("frequency"), F.sort_array(F.collect_list(F.struct("seq", F.to_json("evidence").alias("text")))).alias("found"), F.min("repo_id").alias("repo_id"))
    sure = confidence_of(F.col("rel"))
    return e.select(
        stable_id("edge", F.col("src"), F.col("dst"), F.col("rel")).alias("edge_id"), "repo_id", F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.col("rel").alias("rel_type"), sure.alias("confidence"),
        F.transform("found", lambda x: F.from_json(x["text"], EVIDENCE)).alias("evidence"), F.create_map(F.lit("syntax"), F.lit(1.0), F.lit("symbol_resolution"), sure).alias("score_breakdown"), "frequency",
        F.lit("active").alias("status"), F.lit(1).alias("version"), now.alias("created_at"), now.alias("updated_at"), F.expr("cast(array() as array<string>)").alias("history_ref"),
    )


def has_parent() -> Column:
    return F.coalesce("parent", F.lit("")) != ""


def definitions(obs: DataFrame) -> DataFrame:
    return obs.where(F.col("kind").isin(*NODE_KINDS))


def nodes_of(obs: DataFrame, repo_id: str, at: Column) -> DataFrame:
    """The repository's node and those of prepared observations: the last observation of a node
    counts; its parent is that of the last one that names one."""
    spark, repo_node, defs = obs.sparkSession, repository_id(F.lit(repo_id)), definitions(obs)
    named = F.when(has_parent(), F.struct("seq", "parent"))
    last = last_wins(defs, ["identity"], ["node_id", "repo_id", "kind", "name", "fqname", "language", "file_path", "span", "signature", "doc", "parser"], "seq", F.max(named)["parent"].alias("parent"))
    placed = with_parent(last, defs, "parent", "found")
    nodes = placed.withColumn("parent_id", F.when(F.col("kind") == "file", repo_node).when(has_parent(), F.col("found"))).select(
        "node_id", "repo_id", "kind", "name", "fqname", "language", "file_path", "span", "signature", "parent_id", "doc",
        stable_id("sha256", F.col("repo_id"), F.col("kind"), F.col("fqname"), F.col("file_path"), length=16).alias("hash"), F.lit(1.0).alias("confidence"), F.lit("active").alias("status"),
        F.lit(1).alias("version"), at.alias("created_at"), at.alias("updated_at"), F.array(evidence(F.col("parser"), F.col("span"))).alias("provenance"), F.expr("cast(array() as array<string>)").alias("history_ref"),
    )
    root = spark.range(1).select(repo_node.alias("node_id"), F.lit(repo_id).alias("repo_id"), F.lit("repository").alias("kind"), F.lit(repo_id).alias("name"), F.lit(repo_id).alias("fqname"), F.lit("polyglot").alias("language"))
    root = root.withColumns({"hash": F.lit(""), "confidence": F.lit(1.0), "status": F.lit("active"), "version": F.lit(1), "created_at": at, "updated_at": at, "provenance": F.expr(f"cast(array() as array<{EVIDENCE}>)"), "history_ref": F.expr("cast(array() as array<string>)")})
    return spark.createDataFrame([], NODE).unionByName(nodes).unionByName(root, allowMissingColumns=True)


def resolved_in_steps(rows: DataFrame, defs: DataFrame, name: str, out: str) -> DataFrame:
    """As with_parent, but the names of the row's own file are looked up and stored first, so that only
    rows without one go through the second join."""
    in_file, anywhere = exact_parents(defs)
    in_file = in_file.select(F.col("fqname").alias("__n1"), F.col("language").alias("__l1"), F.col("file_path").alias("__f1"), F.col("in_file").alias(out))
    anywhere = anywhere.select(F.col("fqname").alias("__n2"), F.col("language").alias("__l2"), F.col("anywhere").alias(out))
    first = rows.join(in_file, (F.col(name) == F.col("__n1")) & (F.col("language") == F.col("__l1")) & F.col("file_path").eqNullSafe(F.col("__f1")), "left").drop("__n1", "__l1", "__f1")
    first = stored(first, compact=True)
    open_ = first.where(F.col(out).isNull() & F.col(name).isNotNull()).drop(out)
    second = open_.join(anywhere, (F.col(name) == F.col("__n2")) & (F.col("language") == F.col("__l2")), "left").drop("__n2", "__l2")
    return first.where(F.col(out).isNotNull() | F.col(name).isNull()).unionByName(second)


def placed_of(obs: DataFrame, repo_id: str, more: list[str]) -> DataFrame:
    """Every observation of a node, with the node's parent_id and how it is known (`how`)."""
    defs, w = definitions(obs), Window.partitionBy("identity")
    rows = defs.select(
        "node_id", "identity", "repo_id", "kind", "prefix", "file_path", "ord", *more, has_parent().alias("names_parent"), F.max_by("language", "seq").over(w).alias("language"),
        F.max(F.when(has_parent(), F.struct("seq", "parent"))).over(w)["parent"].alias("parent"),
    )
    placed = resolved_in_steps(rows, defs, "parent", "found")
    how = F.when(F.col("kind") == "file", "file_scan").when(F.col("kind") == "module", "module_path").otherwise(F.concat("prefix", F.lit("_parent")))
    return placed.withColumns({"parent_id": F.when(F.col("kind") == "file", repository_id(F.lit(repo_id))).otherwise(F.col("found")), "how": how})


def uses_of(obs: DataFrame, more: list[str]) -> DataFrame:
    """Imports, bases and calls with the node that they stand in (src) and the nodes that their symbol
    resolves to (dst) or may mean (guess); without those that lead from or to nothing."""
    defs = definitions(obs)
    calls = obs.where("kind = 'call'").withColumns({"module": F.when(F.coalesce("raw.module", F.lit("")) != "", F.col("raw.module")).otherwise(module_scope(F.col("fqname"))), "head": F.substring_index(F.coalesce("target", F.lit("")), ".", 1), "__is_call": F.lit(True)})
    names = obs.where("kind = 'import'").select("language", F.col("fqname").alias("module"), F.col("name").alias("head"), "seq", F.when(F.coalesce("target", F.lit("")) != "", F.col("target")).otherwise(F.col("name")).alias("target"))
    calls = latest_alias(calls, names).withColumn("symbol", rebound(F.coalesce("target", F.lit("")), F.col("raw.class_fqname"), F.col("alias")))
    common = ["repo_id", "kind", "file_path", "ord", "prefix", "fqname", "language", "symbol", *more]
    uses = reduce(DataFrame.unionByName, [calls.select(*common), obs.where(F.col("kind").isin("import", "inherit")).withColumn("symbol", F.col("target")).select(*common)])
    uses = resolved_in_steps(uses.where("symbol IS NOT NULL"), defs, "fqname", "src").where("src IS NOT NULL").drop("fqname")
    # Each symbol is looked up once.
    short = symbol_tables(defs)[1].select(F.col("language").alias("__l"), F.col("key").alias("__k"), F.col("short").alias("guess"))
    asked = with_symbol(uses.select("language", "symbol").distinct(), defs, "symbol", "dst")
    asked = asked.join(short, (F.col("language") == F.col("__l")) & (last_part(F.col("symbol")) == F.col("__k")), "left").drop("__l", "__k")
    return uses.join(stored(asked.where("dst IS NOT NULL OR guess IS NOT NULL"), compact=True), ["language", "symbol"])


def edge_rows(placed: DataFrame, uses: DataFrame, more: list[str]) -> DataFrame:
    """(repo_id, src, dst, rel, seq, type, file_path, *more): a row for each piece of evidence."""

    def rows(found: DataFrame, src: str, dst: Column, rel: Column, kind: Column, **other: Column) -> DataFrame:
        return found.select("repo_id", F.col(src).alias("src"), dst.alias("dst"), rel.alias("rel"), F.struct("file_path", "ord").alias("seq"), kind.alias("type"), "file_path", *(other.get(c, F.col(c)).alias(c) for c in more)).where("src IS NOT NULL AND dst IS NOT NULL")

    # CONTAINS and DEFINES: every observation of a node is evidence of its place.
    contains = rows(placed, "parent_id", F.col("node_id"), F.lit("CONTAINS"), F.col("how"), span=F.when(F.col("kind") != "file", F.col("span")) if "span" in more else None, target=F.lit(None).cast("string"))
    defined = placed.where(F.col("kind").isin(*DEFINITION_KINDS) & F.col("names_parent"))
    defines = rows(defined, "parent_id", F.col("node_id"), F.lit("DEFINES"), F.concat("prefix", F.lit("_define")), target=F.lit(None).cast("string"))
    # Uses: imports, bases and calls, with the name that each resolves.
    is_call = F.col("kind") == "call"
    sure = F.col("dst").isNotNull() & (F.col("dst") != F.col("src"))
    rel = F.when(F.col("kind") == "import", "IMPORTS").when(F.col("kind") == "inherit", "INHERITS").when(sure, "CALLS").otherwise("MAY_CALL")
    to = F.when(~is_call | sure, F.col("dst")).when(F.col("guess") != F.col("src"), F.col("guess"))
    kind = F.concat("prefix", F.when(rel == "MAY_CALL", "_call_unresolved").otherwise(F.concat(F.lit("_"), "kind")))
    return reduce(DataFrame.unionAll, [contains, defines, rows(uses, "src", to, rel, kind)])


def link(observations: DataFrame, repo_id: str, now: str = "") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a repository's observations. `now` is the timestamp of new rows.

    Defined results: no observations give the repository's node alone; nulls in parent, target and
    raw fields mean that the fact is missing; repeated observations raise an edge's frequency. Different
    nodes whose ids agree in all 12 digits (48 bits: about two pairs among 35 million nodes) all stay."""
    return link_nodes(observations, repo_id, now), link_edges(observations, repo_id, now)


def link_nodes(observations: DataFrame, repo_id: str, now: str = "") -> DataFrame:
    return nodes_of(prepared(observations), repo_id, F.lit(now))


def link_edges(observations: DataFrame, repo_id: str, now: str = "") -> DataFrame:
    obs, more = prepared(observations), ["span", "target"]
    found = edge_rows(placed_of(obs, repo_id, ["span"]), uses_of(obs, more), more)
    data = F.when(F.col("rel").isin("CONTAINS", "DEFINES"), F.expr("cast(map() as map<string,string>)")).otherwise(F.create_map(F.lit("target"), F.col("target")))
    proof = F.struct(F.col("type"), F.col("file_path"), F.col("span"), data.alias("data")).cast(EVIDENCE)
    return observations.sparkSession.createDataFrame([], EDGE).unionByName(merged_edges(found.withColumn("evidence", proof), F.lit(now)))


def edge_heads(observations: DataFrame, repo_id: str) -> DataFrame:
    """(edge_id, src_id, dst_id, rel_type, frequency, confidence, first_evidence): the linker's edges with
    the type of their first evidence alone, so that files, places and targets are never moved. An id
    that several nodes share stands for each of them: an edge to it comes once for each, and CONTAINS
    with the evidence of that node."""
    obs = prepared(observations)
    placed = placed_of(obs, repo_id, [])
    found = edge_rows(placed, uses_of(obs, []), [])
    e = found.select("src", "dst", "rel", "seq", "type").repartition("src", "dst", "rel").groupBy("src", "dst", "rel").agg(F.count("*").alias("frequency"), F.min_by("type", "seq").alias("type"))
    print_ = F.xxhash64("identity")
    shared = placed.groupBy("node_id").agg(F.min(print_).alias("low"), F.max(print_).alias("high")).where("low <> high").select("node_id")
    each = placed.join(F.broadcast(stored(shared, compact=True)), "node_id").groupBy(F.col("node_id").alias("dst"), "identity").agg(F.min_by("how", F.struct("file_path", "ord")).alias("how")).drop("identity")
    e = e.join(F.broadcast(stored(each, compact=True)), "dst", "left")
    first = F.when((F.col("rel") == "CONTAINS") & F.col("how").isNotNull(), F.col("how")).otherwise(F.col("type"))
    return e.select(stable_id("edge", F.col("src"), F.col("dst"), F.col("rel")).alias("edge_id"), F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.col("rel").alias("rel_type"), "frequency", confidence_of(F.col("rel")).alias("confidence"), first.alias("first_evidence"))


def downgraded(edges: DataFrame, accept: float = 0.65) -> DataFrame:
    """Calls of low confidence become MAY_CALL, with a confidence of 0.49 at most."""
    low = (F.col("rel_type") == "CALLS") & (F.col("confidence") < accept)
    return edges.withColumns({"confidence": F.when(low, F.least("confidence", F.lit(0.49))).otherwise(F.col("confidence")), "rel_type": F.when(low, "MAY_CALL").otherwise(F.col("rel_type"))})


def superseded(edges: DataFrame, reasons: DataFrame) -> DataFrame:
    """Edges that reasons (edge_id, reason) names get status superseded, a revision score of 1 and the
    reason in their last piece of evidence; the others stay."""
    e = edges.join(reasons.select("edge_id", F.col("reason").alias("__reason")), "edge_id", "left")
    hit = F.col("__reason").isNotNull()
    size = F.size("evidence")
    noted = F.transform("evidence", lambda x, i: F.when(i == size - 1, x.withField("data", F.map_concat(F.map_filter(F.coalesce(x["data"], F.expr("cast(map() as map<string,string>)")), lambda k, v: k != "revision_reason"), F.create_map(F.lit("revision_reason"), F.col("__reason"))))).otherwise(x))
    score = F.map_concat(F.map_filter("score_breakdown", lambda k, v: k != "revision"), F.create_map(F.lit("revision"), F.lit(1.0)))
    return e.withColumns({"status": F.when(hit, "superseded").otherwise(F.col("status")), "score_breakdown": F.when(hit, score).otherwise(F.col("score_breakdown")), "evidence": F.when(hit & (size > 0), noted).otherwise(F.col("evidence"))}).drop("__reason").select(edges.columns)
