"""The driver's tables as entities of the engine. Views, not copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.session import importable


class Tables:
    """The tables of a folder, and what they stand for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = importable(spark), folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @staticmethod
    def keyed(df: DataFrame) -> DataFrame:
        return df.select(F.lit(1).cast("long").alias("repo_id"), F.lit("main").alias("branch"), "*")

    def files(self) -> DataFrame:
        """documents as files."""
        d = self.raw("documents")
        path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
        return self.keyed(d.select("doc_id", path.alias("relative_path"), F.col("lang").alias("language"), F.col("text").alias("content"), F.col("n_chars").alias("size"), F.col("source").alias("partition_name")))

    def chunks(self) -> DataFrame:
        """embeddings as chunks."""
        return self.keyed(self.raw("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label"))

    def definitions(self) -> DataFrame:
        """Parts as functions; p_brand is the file."""
        p = self.raw("part")
        return self.keyed(p.select(node("p", "p_partkey"), F.lit("function_definition").alias("node_type"), part_name().alias("name"), F.col("p_brand").alias("relative_path"), F.col("p_size").alias("start_line"), F.lit(0).alias("start_column"), F.lit(None).cast("string").alias("parent_id"), F.lit(1).alias("depth")))

    def modules(self) -> DataFrame:
        """Orders as modules; the priority is the file and the customer the name."""
        o = self.raw("orders")
        return self.keyed(o.select(node("o", "o_orderkey"), F.lit("module").alias("node_type"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"), F.col("o_orderpriority").alias("relative_path"), F.lit(1).alias("start_line"), F.lit(0).alias("start_column"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth")))

    def nodes(self) -> DataFrame:
        return self.definitions().unionByName(self.modules())

    def returned(self) -> DataFrame:
        """The branch of returned items."""
        return self.raw("lineitem").where("l_returnflag = 'R'")

    def calls(self) -> DataFrame:
        """Each returned item of an order calls its part by a dotted name."""
        called = self.returned().join(self.raw("part").select("p_partkey", part_name().alias("n")), F.col("l_partkey") == F.col("p_partkey"))
        return self.keyed(called.select(node("o", "l_orderkey", "caller"), F.concat(F.lit("pkg.mod."), F.col("n")).alias("called_name")))

    def recent_calls(self) -> DataFrame:
        """Calls by items shipped from 1998 on."""
        called = self.returned().where("l_shipdate >= '1998-01-01'").join(self.raw("part").select("p_partkey", part_name().alias("n")), F.col("l_partkey") == F.col("p_partkey"))
        return self.keyed(called.select(node("o", "l_orderkey", "caller"), F.concat(F.lit("pkg.mod."), F.col("n")).alias("called_name")))

    def edges(self) -> DataFrame:
        return self.keyed(self.returned().select(node("o", "l_orderkey", "caller"), node("p", "l_partkey", "callee")).distinct())

    def recent_edges(self) -> DataFrame:
        """Edges of the branch of items shipped from 1998 on."""
        return self.keyed(self.returned().where("l_shipdate >= '1998-01-01'").select(node("o", "l_orderkey", "caller"), node("p", "l_partkey", "callee")).distinct())

    def deep_edges(self) -> DataFrame:
        """Orders to parts to suppliers to nations to regions."""
        item = self.returned()
        steps = [
            item.select(node("o", "l_orderkey", "caller"), node("p", "l_partkey", "callee")),
            item.select(node("p", "l_partkey", "caller"), node("s", "l_suppkey", "callee")),
            self.raw("supplier").select(node("s", "s_suppkey", "caller"), node("n", "s_nationkey", "callee")),
            self.raw("nation").select(node("n", "n_nationkey", "caller"), node("r", "n_regionkey", "callee")),
        ]
        out = steps[0]
        for s in steps[1:]:
            out = out.union(s)
        return self.keyed(out.distinct())

    def tree_nodes(self) -> DataFrame:
        """Regions, nations and customers as a tree."""
        r = self.raw("region").select(node("r", "r_regionkey"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
        n = self.raw("nation").select(node("n", "n_nationkey"), node("r", "n_regionkey", "parent_id"), F.col("n_name").alias("name"))
        c = self.raw("customer").select(node("c", "c_custkey"), node("n", "c_nationkey", "parent_id"), F.col("c_name").alias("name"))
        return self.keyed(r.union(n).union(c))

    def dir_files(self) -> DataFrame:
        """Customers as files of region/nation/customer."""
        c, n, r = self.raw("customer"), self.raw("nation"), self.raw("region")
        joined = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
        return joined.select(F.concat_ws("/", "r_name", "n_name", F.col("c_custkey").cast("string")).alias("relative_path"), F.floor("c_acctbal").cast("long").alias("size"))

    def tasks(self) -> DataFrame:
        """Orders as root tasks, their items as children."""
        status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("pending")
        o = self.raw("orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("repo_id"), F.lit(None).cast("long").alias("parent_id"), F.col("o_orderpriority").alias("name"), status.alias("status"), F.col("o_orderdate").alias("started_at"))
        i = self.raw("lineitem").join(self.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        child = i.select((-1 - F.col("l_partkey")).alias("task_id"), F.col("o_custkey").alias("repo_id"), F.col("l_orderkey").alias("parent_id"), F.col("l_linestatus").alias("name"), F.lit("completed").alias("status"), F.col("l_shipdate").alias("started_at"))
        return o.unionByName(child)

    def child_tasks(self) -> DataFrame:
        """The children of tasks() without what they take from their parents; an item without an order has a parent that isn't there."""
        return self.raw("lineitem").select((-1 - F.col("l_partkey")).alias("task_id"), F.col("l_orderkey").alias("parent_id"), F.col("l_linestatus").alias("name"), F.lit("completed").alias("status"), F.col("l_shipdate").alias("started_at"))

    def events(self) -> DataFrame:
        return self.raw("events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))

    def billing(self) -> DataFrame:
        """Events as paid calls; sign-ups are local."""
        provider = F.when(F.col("event_type") == "signup", "local").otherwise("api")
        return self.events().select(F.col("event_type").alias("model_name"), provider.alias("provider"), "ts", F.col("k").alias("total_tokens"), F.col("value").alias("cost"))

    def requests(self) -> DataFrame:
        return self.events().select("event_id", F.col("user_id").cast("string").alias("api_key"), F.col("event_type").alias("model_name"), "ts")

    def task_log(self) -> DataFrame:
        """Events as a log of tasks, one task per user."""
        status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
        details = F.create_map(F.lit("k"), F.col("k").cast("string"), F.col("event_type"), F.col("event_id").cast("string"))
        return self.events().select(F.col("user_id").alias("task_id"), "ts", F.col("event_id").alias("seq"), status.alias("status"), F.col("event_type").alias("message"), F.col("value").alias("progress"), details.alias("details"))

    def text_blocks(self) -> DataFrame:
        """Orders as blocks on their customer's page."""
        k = F.col("o_orderkey")
        x, y = ((k * 37) % 500).cast("double"), ((k * 53) % 700).cast("double")
        return self.raw("orders").select(F.col("o_custkey").alias("page"), k.alias("block_id"), F.col("o_orderstatus").alias("text"), x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + 10 + k % 3).alias("y1"))

    def grid_blocks(self) -> DataFrame:
        """Orders as blocks on places of a grid, beside which they lie by less than a unit."""
        k = F.col("o_orderkey")
        x, y = (k * 37 % 8 * 30 + k % 2 * 0.5).cast("double"), (F.floor(k / 8) % 5 * 40).cast("double")
        return self.raw("orders").select(F.pmod("o_custkey", F.lit(50)).alias("page"), k.alias("block_id"), F.concat(F.lit("  "), "o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("text"), x.alias("x0"), y.alias("y0"), (x + 22 + k * 37 % 2 * 2).alias("x1"), (y + 10).alias("y1"))

    def sources(self) -> DataFrame:
        """Parts as Python files: a class with a method that branches and calls."""
        p = self.raw("part")
        k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
        doc = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('        """'), "p_name", F.lit('"""\n'))).otherwise("")
        more = F.repeat(F.concat(F.lit("        if x:\n            x = lib.g"), size, F.lit("(x)\n")), (F.col("p_size") % 4).cast("int"))
        text = F.concat(F.lit("# "), "p_type", F.lit("\nclass C"), k, F.lit(":\n    def f"), k, F.lit("(self, x=1):\n"), doc, more, F.lit("        return h"), size, F.lit("(x)\n\nx = 1\n"))
        return self.keyed(p.select("p_partkey", "p_size", F.concat("p_brand", F.lit("/"), k, F.lit(".py")).alias("relative_path"), text.alias("content"))).withColumn("blob_hash", F.sha2("content", 256))


    def brace_sources(self) -> DataFrame:
        """Parts of even size as JavaScript files, others as Java files: a class with a constructor and a method, and a function or a method without a body."""
        p = self.raw("part")
        js = "// @t\n/** @n */\nclass C@k {\n  constructor(x) { this.x = h@s(x); }\n  async m@k(x) {\n    if (x) { return lib.g@s(x); }\n  }\n}\nconst f@k = (x) => { return m@k(x); };\n"
        java = "// @t\n/** @n */\npublic class C@k {\n  C@k(int x) { this.x = h@s(x); }\n  int m@k(int x) throws E {\n    while (x > 0) { return lib.g@s(x); }\n  }\n  abstract int f@k(int x);\n}\n"
        text, end = F.when(F.col("p_size") % 2 == 0, js).otherwise(java), F.when(F.col("p_size") % 2 == 0, ".js").otherwise(".java")
        for sign, value in (("@t", F.col("p_type")), ("@n", F.col("p_name")), ("@k", F.col("p_partkey").cast("string")), ("@s", F.col("p_size").cast("string"))):
            text = F.replace(text, F.lit(sign), value)
        return self.keyed(p.select(F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), end).alias("relative_path"), text.alias("content")))


def node(prefix: str, key: str, alias: str = "node_id") -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string")).alias(alias)


def part_name() -> Column:
    return F.concat_ws(" ", "p_name", "p_brand", "p_type")


def text_path() -> Column:
    """A path for each document whose suffix follows from its language."""
    end = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".js").when(F.col("lang") == "de", ".JAVA").otherwise(".md")
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), end)
