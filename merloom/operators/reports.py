"""Reports over identification output: read frequencies, roll-ups along the taxonomy, binning, read-wise formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merloom.session import materialise

RANKS = ["superkingdom", "phylum", "class", "order", "family", "genus", "species", "strain"]


def read_frequencies(hits: DataFrame, keys: Sequence[str], n_reads: DataFrame, threshold: float = 0.0, top_only: bool = False, ties_only: bool = True) -> DataFrame:
    """(tax, weight, share): each read gives 1 to the taxa that share its best relative score.

    ``top_only`` looks at top hits only; ``ties_only=False`` shares among all of them. ``n_reads`` is a one-row table (n).
    """
    x = hits.where("hit = 'top'") if top_only else hits
    per = Window.partitionBy(*keys)
    x = x.withColumn("most", F.max("relative").over(per)).where(F.col("most") >= threshold)
    if ties_only:
        x = x.where(F.col("relative") >= F.col("most"))
    x = x.withColumn("w", 1.0 / F.count(F.lit(1)).over(per))
    return x.groupBy("tax").agg(F.sum("w").alias("weight")).select("tax", "weight", (F.col("weight") / n_reads.select("n").scalar()).alias("share"))


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """(tax, parent, rank_name): one row for each node; of differing copies the least parent and rank."""
    return nodes.where("tax is not null and parent is not null").groupBy("tax").agg(F.min("parent").alias("parent"), F.min("rank_name").alias("rank_name"))


def ancestors(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    """(tax, ancestor, rank_name, depth): every listed taxon with itself (depth 0) and all nodes above it; the root ends the path.

    Paths are doubled: steps of 1, 2, 4, ... nodes are joined until none is
    longer, so a path of any depth takes as many rounds as its length has
    binary digits. A loop among the nodes raises.
    """
    step = materialise(nodes.where("parent <> tax").select(F.col("tax").alias("node"), F.col("parent").alias("up")).join(nodes.select(F.col("tax").alias("up")), "up").select("node", "up"))
    wanted = taxa.select("tax").where("tax is not null").distinct().join(nodes.select("tax"), "tax")
    paths = wanted.select("tax", F.col("tax").alias("ancestor"), F.lit(0).alias("depth"))
    n, size = nodes.count(), 1
    while True:
        far = paths.join(step, F.col("ancestor") == F.col("node")).select("tax", F.col("up").alias("ancestor"), (F.col("depth") + size).alias("depth"))
        paths = materialise(paths.unionByName(far))
        longer = step.join(step.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up"))
        step, size = materialise(longer), size * 2
        if step.isEmpty():
            break
        if size > 2 * n:
            raise ValueError("the nodes of the taxonomy form a loop")
    rank = nodes.select(F.col("tax").alias("ancestor"), "rank_name")
    return paths.join(rank, "ancestor").select("tax", "ancestor", "rank_name", "depth")


def closure(nodes: DataFrame) -> DataFrame:
    """The paths of all nodes, written once: a dimension table that reports read several times."""
    return materialise(ancestors(nodes, nodes))


def lift(nodes: DataFrame, taxa: DataFrame, rank: str) -> DataFrame:
    """(tax, upper): the nearest node at or above with the rank; the taxon itself where the path reaches the root's children without it, or ends there."""
    up = closure(nodes)
    n = nodes.select(F.col("tax").alias("a"), "parent")
    at = up.where(F.col("rank_name") == rank).join(n, F.col("ancestor") == F.col("a")).groupBy("tax").agg(F.min(F.struct("depth", "ancestor", "parent")).alias("m"))
    out = taxa.select("tax").where("tax is not null").distinct().join(at, "tax", "left")
    return out.select("tax", F.when(F.col("m").isNull() | (F.col("m.parent") == 1), F.col("tax")).otherwise(F.col("m.ancestor")).alias("upper"))


def roll_up_to_rank(freq: DataFrame, nodes: DataFrame, rank: str) -> DataFrame:
    """(tax, quantity): quantities of taxa summed at the nearest node of a rank, else at the highest node below the root. Unknown taxa are left out."""
    up = closure(nodes)
    n = nodes.select(F.col("tax").alias("a"), "parent")
    stop = (F.col("rank_name") == rank) | (F.col("parent") == 1)
    at = up.join(n, F.col("ancestor") == F.col("a")).where(stop).groupBy("tax").agg(F.min(F.struct("depth", "ancestor")).alias("m"))
    return freq.join(at, "tax").groupBy(F.col("m.ancestor").alias("node")).agg(F.sum("quantity").alias("quantity")).withColumnRenamed("node", "tax")


def taxon_profile(freq: DataFrame, nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(tax, rank_name, path, name_path, percentage, rank_no): quantities added to every node up to the superkingdom.

    Nodes without a rank leave an empty place in the paths; rows come for the
    eight main ranks only.
    """
    paths = up = closure(nodes)
    top = up.where("rank_name = 'superkingdom'").groupBy("tax").agg(F.min("depth").alias("limit"))
    up = up.join(top, "tax", "left").where(F.col("limit").isNull() | (F.col("depth") <= F.col("limit")))
    total = up.join(freq, "tax").groupBy("ancestor").agg(F.sum("quantity").alias("percentage"))
    label = names.groupBy(F.col("tax").alias("nt")).agg(F.min("name").alias("name"))
    own = paths.join(top, "tax", "left").where(F.col("limit").isNull() | (F.col("depth") <= F.col("limit"))).join(label, F.col("ancestor") == F.col("nt"), "left")
    blank = F.coalesce(F.col("rank_name"), F.lit("no rank")) == "no rank"
    step = F.struct((-F.col("depth")).alias("o"), F.when(blank, "").otherwise(F.col("ancestor").cast("string")).alias("id"), F.when(blank, "").otherwise(F.coalesce("name", F.lit("unnamed"))).alias("nm"))
    path = own.groupBy("tax").agg(F.array_sort(F.collect_list(step)).alias("p"), F.max(F.when(F.col("depth") == 0, F.col("rank_name"))).alias("rank_name"))
    rows = path.join(total, F.col("tax") == F.col("ancestor"))
    out = rows.select("tax", "rank_name", F.array_join(F.transform("p", lambda x: x["id"]), "|").alias("path"), F.array_join(F.transform("p", lambda x: x["nm"]), "|").alias("name_path"), "percentage")
    order = F.array_position(F.array(*[F.lit(r) for r in RANKS]), F.col("rank_name"))
    return out.withColumn("rank_no", order).where("rank_no > 0")


def pie_rows(profile: DataFrame) -> DataFrame:
    """(value, name_path): rows of the lowest rank keep their value, all others get 0, and the rest to 100 comes last."""
    low = profile.agg(F.max("rank_no").alias("low")).scalar()
    x = profile.withColumn("value", F.when(F.col("rank_no") == low, F.col("percentage")).otherwise(0.0))
    rest = x.agg((100.0 - F.coalesce(F.sum("value"), F.lit(0.0))).alias("value")).select("value", F.lit("").alias("name_path"))
    return x.select("value", "name_path").unionByName(rest)


def binning(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., tax): the first top hit of every read."""
    return hits.where("rank = 1").select(*keys, "tax")


def reads_of_taxon(reads: DataFrame, hits: DataFrame, keys: Sequence[str], taxa: DataFrame) -> DataFrame:
    """Reads with a top hit among the listed taxa."""
    return reads.join(hits.where("hit = 'top'").join(taxa, "tax", "left_semi").select(*keys).distinct(), list(keys), "left_semi")


def not_identified(reads: DataFrame, hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    return reads.join(hits.select(*keys).distinct(), list(keys), "left_anti")


def _named(hits: DataFrame, names: DataFrame) -> DataFrame:
    label = names.groupBy(F.col("tax").alias("nt")).agg(F.min("name").alias("taxon"))
    return hits.join(label, F.col("tax") == F.col("nt"), "left").withColumn("taxon", F.coalesce("taxon", F.lit("unnamed"))).drop("nt")


def _with_coherence(reads: DataFrame, coherent: DataFrame | None, key: str) -> DataFrame:
    return reads if coherent is None else reads.join(coherent.select(key, "coherence"), key, "left").withColumn("coherence", F.coalesce("coherence", F.lit(0.0)))


def read_json(reads: DataFrame, hits: DataFrame, names: DataFrame, key: str = "read_id", coherent: DataFrame | None = None) -> DataFrame:
    """(read_id, json): one JSON object for each read, with top and further hits; empty lists where nothing matched.

    With ``coherent`` (key, coherence) every hit carries the coherence of its read.
    """
    item = F.struct(F.col("tax").cast("string").alias("tax ID"), F.col("taxon").alias("Name"), F.col("score").alias("k-mer Score"), F.col("relative").alias("Relative Score"), F.col("error").alias("Error"))
    per = _named(hits, names).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "hit", item.alias("item")))).alias("all"))
    x = _with_coherence(reads, coherent, key).join(per, key, "left")
    full = lambda e: e["item"] if coherent is None else e["item"].withField("Coherence", F.col("coherence"))
    pick = lambda h: F.coalesce(F.transform(F.filter("all", lambda e: e["hit"] == h), full), F.array())
    obj = F.struct(F.col(key).alias("Read number"), F.col("name").alias("Specifier from input file"), F.col("seq_len").alias("Length"), pick("top").alias("Top hits"), pick("further").alias("Further hits"))
    return x.select(key, F.to_json(obj, {"ignoreNullFields": "false"}).alias("json"))


def read_tsv(reads: DataFrame, hits: DataFrame, names: DataFrame, key: str = "read_id", coherent: DataFrame | None = None) -> DataFrame:
    """(read_id, name, taxa, names, scores, errors[, coherence]): joined lists in order of rank; ``-`` where nothing matched."""
    per = _named(hits, names).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "tax", "taxon", "relative", "score", "error"))).alias("all"))
    join = lambda f: F.coalesce(F.array_join(F.transform("all", f), ";"), F.lit("-"))
    num = lambda c: F.format_string("%.6f", c)
    more = [] if coherent is None else [num(F.col("coherence")).alias("coherence")]
    return _with_coherence(reads, coherent, key).join(per, key, "left").select(
        key, "name", join(lambda e: e["tax"].cast("string")).alias("taxa"), join(lambda e: e["taxon"]).alias("names"), join(lambda e: F.concat(num(e["relative"]), F.lit(","), num(e["score"]))).alias("scores"), join(lambda e: num(e["error"])).alias("errors"), *more
    )


def read_short(reads: DataFrame, hits: DataFrame, key: str = "read_id") -> DataFrame:
    """(status, name, tax, length, pairs): C or U, first taxon, and taxon:score pairs; ``A:00`` where nothing matched."""
    per = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "tax", "score"))).alias("all"))
    x = reads.join(per, key, "left")
    text = F.array_join(F.transform("all", lambda e: F.concat(e["tax"].cast("string"), F.lit(":"), F.format_string("%.6f", e["score"]))), " ")
    return x.select(key, F.when(F.col("all").isNull(), "U").otherwise("C").alias("status"), "name", F.coalesce(F.element_at("all", 1)["tax"], F.lit(0)).alias("tax"), F.col("seq_len").alias("length"), F.coalesce(text, F.lit("A:00")).alias("pairs"))


_HIT = "array<struct<`tax ID`: string, Name: string, `k-mer Score`: double, `Relative Score`: double, Error: double, Coherence: double>>"
_READ = f"struct<`Read number`: bigint, `Specifier from input file`: string, Length: bigint, `Top hits`: {_HIT}, `Further hits`: {_HIT}>"


def parsed_hits(df: DataFrame) -> DataFrame:
    """The hits of JSON objects as rows; a read without hits has one row of nulls."""
    j = df.select(F.from_json("json", _READ).alias("j"))
    def one(name: str):
        return F.transform(F.col(f"j.`{name} hits`"), lambda x, i: F.struct(F.lit(name.lower()).alias("hit"), (i + 1).cast("long").alias("place"), x.alias("x")))

    lists = F.concat(one("Top"), one("Further"))
    rows = j.select(F.col("j.`Read number`").alias("read_id"), F.col("j.`Specifier from input file`").alias("name"), F.col("j.Length").alias("seq_len"), F.explode_outer(lists).alias("e"))
    x = F.col("e.x")
    return rows.select("read_id", "name", "seq_len", F.col("e.hit").alias("hit"), F.col("e.place").alias("place"), x["tax ID"].cast("long").alias("tax"), x["Name"].alias("taxon"), x["k-mer Score"].alias("score"), x["Relative Score"].alias("relative"), x["Error"].alias("error"), x["Coherence"].alias("coherence"))
