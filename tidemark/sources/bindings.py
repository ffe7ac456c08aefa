"""Fact tables derived from the given tables: sessions as functions, parts as call graph.

Sessions (``events``): a user is a function, the page key ``k`` a block, an event a row; the row
before it of the same user and type is its operand. Parts (``lineitem``): consecutive parts of an
order call each other; nation and order priority of the customer make the module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.labels import ARG, DEP, INDEP
from tidemark.operators.ordered import OrderedRows
from tidemark.session import materialise, sized

FN = ["module", "fn"]
BLOCK = ["module", "fn", "block"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Sessions:
    """Facts of the ``events`` table.

    With ``keep`` the instructions are written once and every other table is taken from them, for callers that want most
    tables: props are parsed once, and each order of the events is sorted once. The rows are the same.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, keep: bool = False):
        self.spark, self.sf_dir, self.keep = spark, sf_dir, keep
        self._rows = self._n_rows = None

    @property
    def n_rows(self) -> int:
        if self._n_rows is None:
            self._n_rows = table(self.spark, self.sf_dir, "events").count()  # from the file footers
        return self._n_rows

    @property
    def events(self) -> DataFrame:
        if self.keep:
            return self.instructions.select("module", "fn", "block", "inst", "opcode", "value", "ts")
        return self._parsed

    @property
    def _parsed(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return sized(table(self.spark, self.sf_dir, "events"), self.n_rows).select(
            (F.col("user_id") % 10).cast("int").alias("module"),
            F.col("user_id").alias("fn"),
            k.alias("block"),
            F.col("event_id").alias("inst"),
            F.col("event_type").alias("opcode"),
            "value",
            "ts",
        )

    @property
    def instructions(self) -> DataFrame:
        """One row per event with position, operand, location and seed label."""
        if self._rows is not None:
            return self._rows
        n = self.n_rows
        by_fn = OrderedRows(self._parsed, FN, ["ts"], rows=n).row_number("pos").lead("block", "next_block")
        by_block = OrderedRows(by_fn.result(), BLOCK, ["ts"], rows=n).row_number("_rn").lead("inst", "_next")
        rows = OrderedRows(by_block.result(), FN + ["opcode"], ["ts"], rows=n).lag("inst", "operand").result()
        level = (
            F.when((F.col("opcode") == "error") & (F.col("value") > 150), DEP)
            .when(F.col("opcode") == "signup", ARG)
            .otherwise(INDEP)
        )
        self._rows = rows.select(
            "module", "fn", "block", "inst", "opcode", "value", "ts",
            F.col("pos").cast("long").alias("pos"),
            (F.col("_rn") - 1).cast("long").alias("idx"),
            "next_block",
            "operand",
            F.col("_next").isNull().alias("is_terminator"),
            F.col("opcode").isin("click", "signup", "error").alias("is_conditional"),
            F.when(F.col("value") >= 10, F.col("block")).alias("line"),
            level.cast("int").alias("level"),
            F.when(F.col("opcode") == "signup", F.col("block") % 3).cast("int").alias("arg"),
        )
        if self.keep:
            self._rows = materialise(self._rows, "instructions")
        return self._rows

    @property
    def labels(self) -> DataFrame:
        return self.instructions.select("module", "fn", "block", "idx", "inst", "opcode", "level", "arg")

    @property
    def seeds(self) -> DataFrame:
        """Long-form seed facts (node = row id); independent rows have none."""
        return self.events.select("module", "fn", F.col("inst").alias("node"), *_seed_facts()).where("level > 1")

    @property
    def operands(self) -> DataFrame:
        rows = self.instructions if self.keep else (
            OrderedRows(self.events, FN + ["opcode"], ["ts"], rows=self.n_rows).lag("inst", "operand").result()
        )
        return rows.where("operand is not null").select(
            "module", "fn", F.col("operand").alias("src"), F.col("inst").alias("dst")
        )

    @property
    def blocks(self) -> DataFrame:
        """Block rows; entry and exit are the blocks of the first and last event of the user."""
        e = self.events
        ends = e.groupBy(*FN).agg(F.min_by("block", "ts").alias("entry"), F.max_by("block", "ts").alias("exit"))
        per_block = e.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n_rows"))
        return per_block.join(ends, FN).select(
            *BLOCK,
            "n_rows",
            (F.col("block") == F.col("entry")).alias("is_entry"),
            (F.col("block") == F.col("exit")).alias("is_exit"),
        )

    @property
    def block_edges(self) -> DataFrame:
        rows = self.instructions if self.keep else (
            OrderedRows(self.events, FN, ["ts"], rows=self.n_rows).lead("block", "next_block").result()
        )
        return (
            rows.where("next_block <> block")
            .select("module", "fn", F.col("block").alias("src"), F.col("next_block").alias("dst"))
            .distinct()
        )

    @property
    def live_edges(self) -> DataFrame:
        """Edges without those leaving a block that holds an error event."""
        failing = self.events.where("opcode = 'error'").select("module", "fn", F.col("block").alias("src")).distinct()
        return self.block_edges.join(failing, FN + ["src"], "left_anti")

    @property
    def functions(self) -> DataFrame:
        """Flags: dependent if the entry block, extracted if the exit block, holds a DEP seed."""
        e = self.events
        ends = e.groupBy(*FN).agg(F.min_by("block", "ts").alias("entry"), F.max_by("block", "ts").alias("exit"))
        hot = e.where("opcode = 'error' and value > 150").select(*BLOCK).distinct()
        at = lambda end: hot.withColumnRenamed("block", end).withColumn(f"_{end}", F.lit(True))
        return (
            ends.join(at("entry"), FN + ["entry"], "left")
            .join(at("exit"), FN + ["exit"], "left")
            .select(
                *FN,
                F.coalesce("_entry", F.lit(False)).alias("is_dep_fn"),
                F.coalesce("_exit", F.lit(False)).alias("is_extracted"),
            )
        )


def _seed_facts():
    level = (
        F.when((F.col("opcode") == "error") & (F.col("value") > 150), DEP)
        .when(F.col("opcode") == "signup", ARG)
        .otherwise(INDEP)
        .cast("int")
    )
    ref = F.when(F.col("opcode") == "signup", F.col("block") % 3).otherwise(-1).cast("int")
    return level.alias("level"), ref.alias("ref")


def _fn_type():
    return F.concat_ws("/", "p_brand", "p_type", (F.col("p_size") % 5).cast("string"))


class Parts:
    """Facts of ``lineitem``, ``orders``, ``customer`` and ``part``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._succ = self._fns = self._calls = None

    @property
    def _lines(self) -> DataFrame:
        li = table(self.spark, self.sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
            "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        )
        orders = table(self.spark, self.sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        cust = table(self.spark, self.sf_dir, "customer").select("c_custkey", "c_nationkey")
        owner = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("l_orderkey"),
            (F.col("c_nationkey") * 10 + F.substring("o_orderpriority", 1, 1).cast("int")).cast("int").alias("module"),
        )
        return li.join(owner, "l_orderkey")

    @property
    def succession(self) -> DataFrame:
        """Every line with its position in the order and the part that follows, written once."""
        if self._succ is None:
            order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
            n = table(self.spark, self.sf_dir, "lineitem").count()  # from the file footers
            rows = OrderedRows(self._lines, ["l_orderkey"], order, rows=n).row_number("pos").lead("l_partkey", "next_part")
            named = rows.result().withColumn("inst", F.concat_ws("-", "l_orderkey", "pos"))
            self._succ = materialise(named.drop("l_suppkey", "l_extendedprice", "l_linenumber"), "succession")
        return self._succ

    @property
    def lines(self) -> DataFrame:
        return self.succession

    @property
    def part(self) -> DataFrame:
        return table(self.spark, self.sf_dir, "part")

    @property
    def edges(self) -> DataFrame:
        return (
            self.succession.where("next_part <> l_partkey")
            .select("module", F.col("l_partkey").alias("src"), F.col("next_part").alias("dst"))
            .distinct()
        )

    @property
    def functions(self) -> DataFrame:
        if self._fns is None:
            self._fns = materialise(self._functions, "functions")
        return self._fns

    @property
    def _functions(self) -> DataFrame:
        members = self.lines.select("module", F.col("l_partkey").alias("fn")).distinct()
        p = self.part.select(
            F.col("p_partkey").alias("fn"),
            F.col("p_name").alias("name"),
            _fn_type().alias("fn_type"),
            "p_brand",
            "p_type",
            "p_size",
            (F.col("p_size") % 2 + 2).cast("int").alias("n_args"),
            (F.col("p_size") % 3 == 0).alias("is_vararg"),
            (F.col("p_size") <= 5).alias("is_declaration"),
        )
        return members.join(p, "fn").select(
            "module", "fn", "name", "fn_type", "p_brand", "p_type", "p_size", "n_args", "is_vararg", "is_declaration"
        )

    @property
    def seeds(self) -> DataFrame:
        return (
            self.functions.where("p_size >= 45")
            .select("module", F.col("fn").alias("node"), F.lit(DEP).alias("level"), F.lit(-1).alias("ref"))
        )

    @property
    def own_lines(self) -> DataFrame:
        """All lines of parts that have a body, the last ones of orders too."""
        declared = self.part.where("p_size <= 5").select(F.col("p_partkey").alias("l_partkey"))
        return self.succession.join(declared, "l_partkey", "left_anti")

    @property
    def call_lines(self) -> DataFrame:
        """Lines that are calls: a successor exists and the caller has a body."""
        return self.own_lines.where("next_part is not null")

    @property
    def calls(self) -> DataFrame:
        """Direct, through an alias, by signature or by table slot; written once."""
        if self._calls is None:
            self._calls = materialise(self._call_facts, "calls")
        return self._calls

    @property
    def _call_facts(self) -> DataFrame:
        tail = self.part.select(
            F.col("p_partkey").alias("next_part"), _fn_type().alias("t_fn_type"), "p_type", F.col("p_size").alias("size")
        )
        low = F.col("l_tax") < 0.02
        by_type = low & (F.col("l_linestatus") == "F")
        by_slot = low & (F.col("l_linestatus") == "O")
        aliased = (F.col("l_returnflag") == "A") & (F.col("l_tax") >= 0.07)
        offset = F.lit(8) * (F.col("size") % 5) + F.when(F.col("size") == 50, 4).otherwise(0)
        return self.call_lines.join(tail, "next_part").select(
            "module",
            F.col("l_partkey").alias("fn"),
            "inst",
            F.when(~low & ~aliased, F.col("next_part")).alias("callee"),
            F.when(aliased, F.col("next_part")).alias("alias_of"),
            F.when(by_type, F.col("t_fn_type")).alias("fn_type"),
            F.when(by_slot, F.col("p_type")).alias("type_id"),
            F.when(by_slot, offset).cast("int").alias("slot_offset"),
        )

    @property
    def call_args(self) -> DataFrame:
        """Three actual arguments per call: level, and the caller's argument at level ARG."""
        return self.call_lines.select("module", F.col("l_partkey").alias("fn"), "inst", F.inline(self._actuals))

    def call_args_without(self, arg_no: int, lines: F.Column) -> DataFrame:
        """``call_args`` but argument ``arg_no`` of the lines where ``lines`` holds."""
        gone = F.coalesce(lines, F.lit(False)).alias("_gone")
        rows = self.call_lines.select("module", F.col("l_partkey").alias("fn"), "inst", gone, F.inline(self._actuals))
        return rows.where(~(F.col("_gone") & (F.col("arg_no") == arg_no))).drop("_gone")

    @property
    def _actuals(self) -> F.Column:
        arg = lambda no, cond, level, ref: F.struct(
            F.lit(no).alias("arg_no"),
            F.when(cond, level).otherwise(INDEP).cast("int").alias("level"),
            F.when(cond, ref).otherwise(-1).cast("int").alias("ref"),
        )
        return F.array(
            arg(0, F.col("l_quantity") >= 40, DEP, -1),
            arg(1, F.col("l_discount") >= 0.09, DEP, -1),
            arg(2, F.col("l_tax") >= 0.07, ARG, 2),
        )

    @property
    def vtable_types(self) -> DataFrame:
        """Two tables per type; those of the first type are not constant."""
        first = self.part.agg(F.min("p_type")).scalar()
        return (
            self._vtables.select("module", "vtable", "type_id")
            .distinct()
            .select(
                "module", "vtable", "type_id",
                F.lit(16).alias("offset"), F.lit(8).alias("elem_size"),
                (F.col("type_id") != first).alias("is_constant"),
            )
        )

    @property
    def _vtables(self) -> DataFrame:
        half = F.when(F.col("p_brand") < "Brand#2", "a").otherwise("b")
        return self.functions.select(
            "module", F.concat_ws("/", "p_type", half).alias("vtable"), F.col("p_type").alias("type_id"),
            "fn", "p_size", "is_declaration",
        )

    @property
    def vtable_slots(self) -> DataFrame:
        """Slots 2..5: smallest function of the group, pure if it is only declared."""
        return (
            self._vtables.groupBy("module", "vtable", (F.col("p_size") % 4 + 2).cast("int").alias("slot_no"))
            .agg(F.min("fn").alias("target"), F.min_by("is_declaration", "fn").alias("is_pure"))
        )

    @property
    def models(self) -> DataFrame:
        """Models of declared parts: return by name length, out-argument for gears, callback for rods."""
        names = (
            self.part.where("p_size <= 5 and p_name not like '%gizmo%'").select(F.col("p_name").alias("name")).distinct()
        )
        kind = F.length("name") % 3
        ints = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<int>")
        ret = F.struct(
            F.lit("return").alias("target"),
            F.when(kind == 0, ARG).when(kind == 1, DEP).otherwise(INDEP).cast("int").alias("level"),
            F.when(kind == 0, ints(0, 1)).otherwise(ints()).alias("arg_deps"),
        )
        out = F.struct(F.lit("0").alias("target"), F.lit(ARG).alias("level"), ints(1, 2).alias("arg_deps"))
        targets = F.when(F.col("name").endswith("gear"), F.array(ret, out)).otherwise(F.array(ret))
        callbacks = F.when(F.col("name").endswith("rod"), ints(1)).otherwise(ints())
        return names.select("name", callbacks.alias("callbacks"), F.inline(targets)).select(
            "name", "target", "level", "arg_deps", "callbacks", F.lit("config").alias("source")
        )
