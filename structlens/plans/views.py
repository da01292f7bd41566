"""The benchmark tables in the roles of code views.

nation is a module, customer a build unit whose market segment gives the category, orders are classes and lineitems
their members; parts are what a class imports. Suppliers form the class and package graphs, parts a manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_data_class


class Views:
    """Lazy views over one folder of tables; columns that a query doesn't use never leave the scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def modules(self) -> DataFrame:
        return self.table("nation").select(F.col("n_name").alias("module"))

    def units(self) -> DataFrame:
        kind = F.when(F.col("c_mktsegment") == "MACHINERY", "generated").when(F.col("c_mktsegment") == "HOUSEHOLD", "test").otherwise("production")
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("module"))
        return self.table("customer").select("c_custkey", "c_nationkey", kind.alias("category")).join(nation, "c_nationkey").select(F.col("c_custkey").alias("unit"), "module", "category")

    def classes(self) -> DataFrame:
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("class"), F.col("o_custkey").alias("unit"), (F.col("o_orderpriority") != "4-NOT SPECIFIED").alias("documented"), F.col("o_orderpriority").alias("annotation")
        )
        return orders.join(self.units(), "unit").select("module", "category", "unit", "class", "documented", "annotation")

    def members(self, with_keys: bool = False) -> DataFrame:
        """Members; with_keys also has their part and their annotation as nested() gives it."""
        flag = F.col("l_returnflag")
        mark = F.when(F.col("l_quantity") <= 25, F.when(flag == "N", "Override").when(F.col("l_tax") == 0, "org.frame.Bean"))
        keys = [F.col("l_partkey").alias("part"), mark.alias("mark")] if with_keys else []
        return self.table("lineitem").select(
            *keys,
            F.col("l_orderkey").alias("class"), F.col("l_returnflag").alias("visibility"), (F.col("l_linestatus") == "F").alias("is_static"), (F.col("l_discount") == 0).alias("is_final"),
            F.col("l_linenumber").alias("parameter_count"), F.when(F.col("l_tax") != 0, F.col("l_quantity").cast("int")).alias("lines_of_code"), F.col("l_linenumber").alias("complexity"),
            (F.col("l_linenumber") - 1).alias("nesting"), (F.col("l_tax") > 0).alias("documented"), F.when(F.col("l_returnflag") == "N", F.col("l_linestatus")).otherwise(F.col("l_returnflag")).alias("annotation"),
        )

    def methods(self) -> DataFrame:
        return self.members().join(self.classes().select("class", "module", "category"), "class")

    def class_counts(self) -> DataFrame:
        """Classes with their numbers of members; those without any have 0."""
        counted = self.members().groupBy("class").agg(
            F.count("*").alias("n_methods"), F.count_if(F.col("visibility") == "N").alias("n_fields"), F.countDistinct("visibility").alias("n_interfaces"), F.count_if(~F.col("visibility").isin("A", "R")).alias("n_other")
        )
        return self.classes().join(counted, "class", "left").fillna(0, ["n_methods", "n_fields", "n_interfaces"])

    def imports(self) -> DataFrame:
        """Distinct parts of each order as dotted names; a null import for orders without."""
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(".", "p_brand", "p_type", "p_name").alias("import"))
        used = self.table("lineitem").select(F.col("l_orderkey").alias("class"), "l_partkey").distinct().join(part, "l_partkey").select("class", "import").distinct()
        return self.classes().select("module", "category", "class", "unit").join(used, "class", "left").withColumn("package", F.lit("Brand#11"))

    def nested(self) -> DataFrame:
        """Classes in the shape that structlens.sources.report.classes() gives them, with fields, methods and annotations nested.

        Lineitems of more than 25 pieces are fields, others methods, named by their return flag. A class extends a third of
        the orders, has up to 7 interfaces, and imports a class or a package for each lineitem.
        """
        none = F.lit(None).cast("string")
        part, flag = F.col("l_partkey").cast("string"), F.col("l_returnflag")
        name = F.concat(F.when(flag == "N", "get").when(flag == "A", "set").otherwise("run"), part)
        annotation = F.when(flag == "N", F.array(F.struct(F.lit("Override").alias("name"), none.alias("qualifiedName")))).when(
            F.col("l_tax") == 0, F.array(F.struct(F.lit("Bean").alias("name"), F.lit("org.frame.Bean").alias("qualifiedName")))
        )
        method = F.struct(
            name.alias("name"), F.concat(name, F.lit("(I"), F.expr("repeat('Z', l_linenumber % 5)"), F.lit("LZed;[Z)Z")).alias("descriptor"), F.when(F.col("l_tax") > 0, "says").alias("documentation"),
            F.coalesce(annotation, F.array().cast("array<struct<name:string,qualifiedName:string>>")).alias("annotations"), (F.col("l_linenumber") * 3).cast("int").alias("cyclomaticComplexity"),
            F.when(flag == "N", "PUBLIC").when(flag == "A", "PRIVATE").alias("visibility"), (F.col("l_linestatus") == "F").alias("isStatic"), (F.col("l_discount") == 0).alias("isFinal"),
            F.col("l_linenumber").alias("parameterCount"), F.when(F.col("l_tax") != 0, F.col("l_quantity").cast("int") * 2).alias("linesOfCode"), (F.col("l_linenumber") - 1).cast("int").alias("nestingDepth"),
        )
        field = F.struct(
            F.concat(F.lit("f"), part).alias("name"), F.lit("int").alias("type"), F.when(F.col("l_linestatus") == "O", "PRIVATE").otherwise("PUBLIC").alias("visibility"),
            (F.col("l_discount") == 0).alias("isStatic"), (F.col("l_tax") == 0).alias("isFinal"),
        )
        used = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("org.C"), (F.col("l_orderkey") + F.col("l_partkey")).cast("string"))).otherwise(F.concat(F.lit("pkg.n"), (F.col("l_suppkey") % 25).cast("string"), F.lit(".X")))
        large = F.col("l_quantity") > 25
        members = self.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
            F.collect_list(F.when(large, field)).alias("fields"), F.collect_list(F.when(~large, method)).alias("methods"), F.collect_list(used).alias("unit_imports")
        )
        order = self.classes().select("module", "category", "unit", F.col("class").alias("id"), "documented", F.col("annotation").alias("priority"))
        home = self.table("nation").select(F.col("n_name").alias("module"), F.concat(F.lit("pkg.n"), F.col("n_nationkey").cast("string")).alias("package"))
        both = order.join(home, "module").join(members, "id", "left")
        schema = dict(both.dtypes)
        empty = lambda c: F.coalesce(c, F.array().cast(schema[c]))
        qualified = lambda k: F.concat(F.lit("org.C"), k.cast("string"))
        return both.select(
            "module", "category", "package", F.col("unit").cast("string").alias("unit"), empty("unit_imports").alias("unit_imports"), qualified(F.col("id")).alias("class"),
            F.when(F.col("id") % 3 == 0, qualified(F.expr("id div 3"))).alias("super_class"), (F.col("id") % 8).cast("int").alias("n_interfaces"), F.size(empty("fields")).alias("n_fields"),
            F.size(empty("methods")).alias("n_methods"), "documented", is_data_class(empty("fields"), empty("methods")).alias("is_data_class"), empty("fields").alias("fields"),
            empty("methods").alias("methods"), F.array(F.struct(F.col("priority").alias("name"), F.lit(None).cast("string").alias("qualifiedName"))).alias("annotations"),
        )

    def part_needs(self) -> DataFrame:
        """(node, needs): a part needs those of half and of a third of its number; every 64th and the next one need each other."""
        key = F.col("p_partkey")
        pair = F.when(key % 64 == 40, key + 1).when(key % 64 == 41, key - 1)
        needs = F.array_distinct(F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3"), pair))
        each = self.table("part").select(key.alias("node"), F.explode(F.filter(needs, lambda x: x > 0)).alias("needs"))
        known = self.table("part").select(key.alias("needs"))
        return each.join(known, "needs").select("node", "needs").unionByName(self.table("part").select(key.alias("node"), F.lit(None).cast("long").alias("needs")))

    def supplier_classes(self) -> DataFrame:
        """(module, package, class): suppliers as classes of their nation's package."""
        package = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
        return self.table("supplier").select(F.lit("all").alias("module"), package.alias("package"), F.concat(package, F.lit(".s"), F.col("s_suppkey").cast("string")).alias("class"), "s_suppkey", "s_nationkey")

    def supplier_imports(self) -> DataFrame:
        """(module, package, class, import): supplier k imports supplier (7 k + nation) modulo the number of suppliers."""
        classes = self.supplier_classes()
        n = classes.agg(F.count("*").alias("n"))
        wanted = classes.join(F.broadcast(n)).withColumn("dst", F.pmod(F.col("s_suppkey") * 7 + F.col("s_nationkey"), F.col("n"))).select("module", "package", "class", "dst")
        return wanted.join(classes.select(F.col("s_suppkey").alias("dst"), F.col("class").alias("import")), "dst").select("module", "package", "class", "import")

    def sbom(self) -> DataFrame:
        """Manifests of parts, one for each brand and size; licences are the brand by name, large parts' types by expression."""
        license = F.struct(F.struct(F.lit(None).cast("string").alias("id"), F.col("p_brand").alias("name")).alias("license"), F.lit(None).cast("string").alias("expression"))
        expression = F.struct(F.lit(None).cast("struct<id:string,name:string>").alias("license"), F.col("p_type").alias("expression"))
        component = F.struct(
            F.col("p_partkey").cast("string").alias("bom-ref"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("group"), F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("version"),
            F.when(F.col("p_size") > 25, F.array(license, expression)).otherwise(F.array(license)).alias("licenses"),
        )
        return self.table("part").groupBy("p_brand", "p_size").agg(F.collect_list(component).alias("components"))

    def module_uses(self) -> DataFrame:
        """(from, to, n): customers' nations that buy from suppliers' nations, over all lineitems."""
        sold = self.table("lineitem").select("l_orderkey", "l_suppkey")
        name = self.table("nation").select("n_nationkey", "n_name")
        seller = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")).join(name, "n_nationkey").select("l_suppkey", F.col("n_name").alias("to"))
        buyer = self.classes().select(F.col("class").alias("l_orderkey"), F.col("module").alias("from"))
        return sold.join(buyer, "l_orderkey").join(seller, "l_suppkey").groupBy("from", "to").agg(F.count("*").alias("n"))

    def module_surplus(self) -> DataFrame:
        """(from, to, n): by how many lineitems a nation buys more from another than that buys from it. Every lineitem
        counts in it; the uses themselves join nearly all nations both ways, which leaves every instability at 50."""
        uses = self.module_uses()
        back = uses.select(F.col("to").alias("from"), F.col("from").alias("to"), (-F.col("n")).alias("n"))
        return uses.unionByName(back).groupBy("from", "to").agg(F.sum("n").alias("n")).where("n > 0")

    def files(self) -> DataFrame:
        """Pages as files: host and path without the last part are the directory."""
        page = self.table("pages").select("page_id", F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "").alias("path"), F.col("html"))
        name = F.substring_index("path", "/", -1)
        lines = F.length("html") - F.length(F.replace("html", F.lit("\n"), F.lit(""))) + F.when(F.col("html").endswith("\n") | (F.col("html") == ""), 0).otherwise(1)
        return page.select("page_id", "path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"), name.alias("filename"), lines.cast("long").alias("lines"))

    def tree(self) -> DataFrame:
        """files() in a deeper tree: every digit of a path is a directory, the last part a file."""
        path = F.rtrim(F.regexp_replace("path", "([0-9])", "$1/"), F.lit("/"))
        deep = self.files().select(path.alias("path"), "lines")
        return deep.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"), F.substring_index("path", "/", -1).alias("filename"), "lines")

    def symbols(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(names, imports, classes) for operators.symbols: parts are classes of their brand's package; an order is a unit that
        names its lineitems' parts, the seventh with its package; it imports the first part, and all of the second's and
        third's packages."""
        package, simple = F.concat(F.lit("b"), F.expr("substring(p_brand, 7)")), F.translate("p_name", " ", "_")
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), package.alias("of"), simple.alias("simple"))
        own = F.concat(F.lit("b"), (F.col("o_custkey") % 30).cast("string"))
        order = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("unit"), own.alias("package"))
        each = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(part, "l_partkey").join(order, "l_orderkey")
        qualified = F.concat_ws(".", "of", "simple")
        names = each.select("unit", "package", F.concat_ws(".", "package", "unit").alias("class"), F.when(F.col("l_linenumber") == 7, qualified).otherwise(F.col("simple")).alias("name"))
        wildcard = F.col("l_linenumber") > 1
        imports = each.where("l_linenumber <= 3").select("unit", F.when(wildcard, F.col("of")).otherwise(qualified).alias("import"), wildcard.alias("wildcard"))
        classes = part.select(qualified.alias("unit"), F.col("of").alias("package"), qualified.alias("class")).distinct()
        return names, imports, classes

    def estate(self) -> dict[str, DataFrame]:
        """Flattened views with large classes of many kinds, so that every rule has findings: customers are classes, their
        lineitems members and imports. A customer's module is that of half its number, so superclasses stay inside; what
        members are like depends on the module m."""
        k, module = F.col("c_custkey"), lambda m: F.concat(F.lit("M"), m.cast("string"))
        m = F.expr("if(c_custkey < 16, c_custkey, shiftright(c_custkey, length(bin(c_custkey)) - 4))")
        named = lambda x: F.concat(F.lit("C"), x.cast("string"))
        category = F.when((k % 5 == 0) & (m % 4 != 1), "test").otherwise("production")
        customer = self.table("customer").select(k.alias("k"), m.cast("long").alias("m"), category.alias("category"))
        each = self.table("lineitem").join(self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("k")), "l_orderkey").join(customer, "k")
        flag, m, part = F.col("l_returnflag"), F.col("m"), F.col("l_partkey")
        override = (flag == "N") & ((m % 2 == 0) | (F.col("l_linenumber") == 7))
        mark = F.when(override, "Override").when((F.col("l_tax") == 0) | (m % 6 == 1), "org.frame.Bean")
        visibility = F.when((m % 5 == 0) | (m % 5 == 1) & (F.col("l_linenumber") <= 5), "PUBLIC").when(flag == "N", "PUBLIC").when(flag == "A", "PRIVATE").otherwise("PROTECTED")
        static = F.when(m % 3 == 0, F.col("l_linestatus") == "F").otherwise(F.col("l_discount") == 0)
        used = F.when(m % 4 == 3, F.concat(F.lit("org.lib.P"), part.cast("string"))).when(
            m % 4 == 1, F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("java.util.P"), part.cast("string"))).otherwise(F.concat(F.lit("com.v"), (part % 5).cast("string"), F.lit(".Q")))
        ).otherwise(F.when(F.col("l_linenumber") > 1, F.concat(F.lit("pkg.m"), m.cast("string"), F.lit(".C"), part.cast("string"))).otherwise(F.concat(F.lit("org.x"), (part % 9).cast("string"), F.lit(".Y"))))
        lines = each.select(
            module(m).alias("module"), "m", "category", named(F.col("k")).alias("class"), "k", (F.col("l_quantity") > 40).alias("is_field"), visibility.alias("visibility"), static.alias("is_static"),
            (F.col("l_discount") == 0).alias("is_final"), (F.col("l_linenumber") + (F.col("l_quantity").cast("int") % 4)).alias("parameter_count"),
            F.when(F.col("l_tax") != 0, F.col("l_quantity").cast("int") * 2).alias("lines_of_code"), (part % 25).alias("complexity"), (F.col("l_suppkey") % 8).alias("nesting"),
            (F.col("l_linenumber") % 5).alias("n_booleans"), mark.alias("mark"), used.alias("import"), F.concat(F.lit("pkg.m"), m.cast("string")).alias("package"), part.alias("part"),
        )
        sizes = lines.groupBy("k").agg(F.count_if("is_field").alias("n_fields"), F.count_if(~F.col("is_field")).alias("n_methods"))
        above = F.when((F.col("k") % 4 != 3) & (F.col("m") != 8) & (F.col("k") >= 16), named(F.expr("k div 2")))
        classes = customer.join(sizes, "k", "left").fillna(0, ["n_fields", "n_methods"]).select(
            module(F.col("m")).alias("module"), "m", "category", named(F.col("k")).alias("class"), above.alias("super_class"), (F.col("k") % 8).alias("n_interfaces"), "n_fields", "n_methods",
            ((F.col("m") % 2 == 0) | (F.col("k") % 3 == 0)).alias("documented"), (F.col("k") % 7 == 0).alias("is_data_class"), F.concat(F.lit("pkg.m"), F.col("m").cast("string")).alias("package"), "k",
        )
        methods = lines.where("not is_field").withColumn("annotations", F.when(F.col("mark").isNotNull(), F.array(F.struct(F.col("mark").alias("name")))).otherwise(F.array().cast("array<struct<name:string>>")))
        tests = F.when(F.col("category") == "test", F.concat(named(F.col("k") + 1), F.lit("Test"))).otherwise(F.col("class"))
        to = F.col("part") % 16
        edges = lines.where((F.col("m") != 5) & (to != 5) & (to < F.col("m")) | (F.col("m") == 1) & (to == 15)).groupBy(F.col("module").alias("from"), module(to).alias("to")).agg(F.count("*").alias("import_count"))
        return {
            "classes": classes, "methods": methods, "fields": lines.where("is_field"), "imports": lines.select("module", "category", "class", "package", "import"),
            "annotations": methods.where("mark is not null").select("module", "category", F.col("mark").alias("name")), "names": classes.select("module", "category", tests.alias("name")),
            "namespaces": classes.select("module", F.col("package").alias("namespace")).distinct(), "edges": edges, "modules": classes.select("module").distinct(),
        }
