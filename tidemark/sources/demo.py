"""The driver tables as two event timelines.

Purchases: one subject per customer, years of history, stamps without time of day.
Activity: one subject per user, days of history, sub-day stamps and one date-only kind.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.config import ExampleConfig, FeatureConfig, SequenceConfig, Span, TableSpec, TimelineSpec
from tidemark.functions.hashing import draw
from tidemark.functions.scalars import sigmoid
from tidemark.functions.time import span_of
from tidemark.operators import examples as E, features as FE, folds as FO, labels as L, sequences as SQ, stats as ST, timeline as TL
from tidemark.session import configure
from tidemark.sources.materialise import fingerprint, materialise
from tidemark.sources.tables import scan_event_table, scan_targets, scan_text_answers

BRANDS = [f"Brand#{i}" for i in range(1, 26)]
KINDS_B = ("view", "signup", "click", "purchase", "error")
CODES_B = [str(i) for i in range(10)]


class Driver:
    """Lazily opened driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def split_of(subject) -> F.Column:
    h = draw("split", subject) % 10
    return F.when(h == 0, "test").when(h == 1, "val").otherwise("train")


class Timeline:
    """What the two fixtures share; cohort, events and rolling examples are stored, the rest is lazy."""

    spec: TimelineSpec
    example_cfg: ExampleConfig
    feature_cfg: FeatureConfig
    sequence_cfg: SequenceConfig

    ENTRY_POINTS = {"cohort": "cohort", "events": "events", "examples": "rolling", "labels": "rolling_labels"}

    name: str
    inputs: tuple[str, ...]
    # Where stored tables live; by default below the shared checkpoint folder.
    root: str | None = None
    mark: str | None = None

    def __init__(self, spark: SparkSession, folder: str):
        self.driver = Driver(spark, folder)

    def stored(self, part: str, build) -> DataFrame:
        """One of the few tables every later stage reads, written once per input state."""
        paths = [f"{self.driver.folder}/{t}.parquet" for t in self.inputs]
        configs = (self.spec, self.example_cfg, self.feature_cfg, self.sequence_cfg)
        if self.mark is None:  # the input files are listed once for all parts
            self.mark = fingerprint(self.driver.spark, paths, *configs)
        return materialise(self.driver.spark, f"{self.name}_{part}", build, paths, *configs, root=self.root, mark=self.mark)

    @cached_property
    def splits(self) -> DataFrame:
        return self.visits.select("subject_id").distinct().withColumn("split", split_of(F.col("subject_id")))

    @cached_property
    def given_anchors(self) -> DataFrame:
        """Stand-in for supplied anchors: 30 days after the derived one, for the held-out split."""
        derived = TL.anchor_from_visits(self.visits, self.spec)
        held = derived.filter(split_of(F.col("subject_id")) == "test")
        return held.select("subject_id", (F.col("derived_anchor") + span_of(Span(30, "day"))).alias("given_anchor"))

    @cached_property
    def cohort(self) -> DataFrame:
        return self.stored("cohort", lambda: TL.build_cohort(
            self.subjects, self.visits, self.splits, self.given_anchors, self.spec))

    @cached_property
    def events(self) -> DataFrame:
        return self.stored("events", lambda: TL.snap_date_only(
            TL.union_timeline(self.tables, self.cohort, self.spec), self.spec))

    @cached_property
    def examples(self) -> DataFrame:
        """Real examples only."""
        return E.real_examples(self.cohort, self.example_cfg)

    @cached_property
    def rolling(self) -> DataFrame:
        """Real examples plus rolling ones for the train split."""
        return self.stored("rolling", lambda: E.build_examples(self.cohort, self.events, self.example_cfg))

    @cached_property
    def first(self) -> DataFrame:
        return L.first_ever(self.events, self.targets, self.spec)

    @cached_property
    def labels(self) -> DataFrame:
        return L.label_pairs(self.examples, self.first, self.targets)

    @cached_property
    def scope(self) -> DataFrame:
        """Subjects statistics may be fitted on."""
        return self.cohort.filter(F.col("split") == "train").select("subject_id")


    @cached_property
    def vocabulary(self) -> DataFrame:
        return self.stored("vocabulary", lambda: ST.fit_vocabulary(self.events, self.scope, self.feature_cfg))

    @cached_property
    def labs(self) -> DataFrame:
        return self.stored("labs", lambda: ST.lab_coverage(self.events, self.scope, self.feature_cfg))

    @cached_property
    def fitted(self) -> FE.Fitted:
        return FE.Fitted(
            self.vocabulary, self.stored("value_edges", lambda: ST.fit_value_edges(self.events, self.scope, self.feature_cfg)),
            self.labs, self.stored("feature_reasons", lambda: ST.fit_reasons(self.events, self.scope, self.feature_cfg)))

    @cached_property
    def shape(self) -> DataFrame:
        return self.stored("shape", lambda: FE.history_shape(self.usable, self.cells, self.rolling, self.feature_cfg))

    @cached_property
    def usable(self) -> DataFrame:
        return FE.usable_events(self.events, self.vocabulary, self.feature_cfg)

    @cached_property
    def cells(self) -> DataFrame:
        return self.stored("cells", lambda: FE.event_cells(self.usable, self.rolling, self.feature_cfg))

    @cached_property
    def sequence_vocab(self) -> SQ.Vocabulary:
        """The fitted vocabulary; its three small tables are stored, as every tokenised event looks them up."""
        fitted = []

        def fit() -> SQ.Vocabulary:
            if not fitted:
                fitted.append(SQ.build_vocab(self.events, self.cohort, self.scope, self.sequence_cfg,
                                             self.spec.kind_order, self.spec.demographics, self.answers))
            return fitted[0]

        return SQ.Vocabulary(self.stored("vocab", lambda: fit().tokens), self.stored("edges", lambda: fit().edges),
                             self.stored("reasons", lambda: fit().reasons))

    answers = None

    @cached_property
    def sequences(self) -> DataFrame:
        return self.stored("sequences", lambda: SQ.build_sequences(
            self.events, self.rolling, self.cohort, self.sequence_vocab, self.sequence_cfg, self.spec.kind_order,
            self.spec.demographics, self.answers))

    @cached_property
    def rolling_labels(self) -> DataFrame:
        return self.stored("labels", lambda: L.label_pairs(self.rolling, self.first, self.targets))

    def load(self, part: str) -> DataFrame:
        """One of ``ENTRY_POINTS``: read where it is stored for these inputs, configuration and code, else built and stored."""
        return getattr(self, self.ENTRY_POINTS[part])

    @cached_property
    def target_tokens(self) -> DataFrame:
        return self.targets.select(F.concat_ws("_", F.lit(self.spec.target_kind), "code").alias("token"))

    @cached_property
    def features(self) -> DataFrame:
        """All blocks for the rolling examples."""
        return self.stored("features", lambda: FE.build_features(
            self.events, self.rolling, self.rolling_labels, self.cohort, self.scope, self.target_tokens,
            self.feature_cfg, self.spec.demographics, self.fitted, self.cells, self.shape))


class Purchases(Timeline):
    name = "purchases"
    inputs = ("orders", "lineitem", "part", "customer", "nation", "region")
    spec = TimelineSpec(Span(2), "ORD", ("ORD", "ITEM", "SHIP"), target_kind="ITEM",
                        demographics=("segment", "nation", "region"))
    example_cfg = ExampleConfig(Span(1), Span(2), 10, ("train",))
    feature_cfg = FeatureConfig(windows=(365.0, 1825.0), shape_kinds=("ORD", "ITEM"), n_common=5)
    sequence_cfg = SequenceConfig(block_size=32)

    @cached_property
    def orders(self) -> DataFrame:
        open_stop = F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate"))
        return self.driver.table("orders").withColumn("stop", open_stop)

    @cached_property
    def lines(self) -> DataFrame:
        line = self.driver.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
        head = self.orders.select("o_orderkey", "o_custkey", "o_orderdate")
        part = self.driver.table("part").select("p_partkey", "p_brand", "p_type")
        return (line.join(head, F.col("l_orderkey") == F.col("o_orderkey"))
                .join(part, F.col("l_partkey") == F.col("p_partkey"))
                .withColumn("value_type", F.lit("numeric")))

    @cached_property
    def shipments(self) -> DataFrame:
        line = self.driver.table("lineitem").select("l_orderkey", "l_shipdate", "l_returnflag")
        head = self.orders.select("o_orderkey", "o_custkey")
        return line.join(head, F.col("l_orderkey") == F.col("o_orderkey"))

    order_spec = TableSpec("orders", "ORD", "o_orderdate", "o_orderpriority", "o_custkey", stop="stop",
                           costs=("o_totalprice",))
    line_spec = TableSpec("lines", "ITEM", "o_orderdate", "p_brand", "o_custkey", reason="p_type",
                          reason_is_code=False, value="l_quantity", value_type="value_type",
                          costs=("l_extendedprice",))
    ship_spec = TableSpec("shipments", "SHIP", "l_shipdate", "l_returnflag", "o_custkey")

    @cached_property
    def visits(self) -> DataFrame:
        return scan_event_table(self.orders, self.order_spec)

    @cached_property
    def tables(self) -> list[DataFrame]:
        return [self.visits, scan_event_table(self.lines, self.line_spec)]

    @cached_property
    def subjects(self) -> DataFrame:
        key = F.col("c_custkey")
        birth = F.make_date((1930 + key % 60).cast("int"), (1 + key % 12).cast("int"), F.lit(1))
        nation = self.driver.table("nation").select("n_nationkey", "n_name", "n_regionkey")
        region = self.driver.table("region").select("r_regionkey", "r_name")
        return (self.driver.table("customer")
                .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
                .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
                .select(key.alias("subject_id"), birth.cast("timestamp_ntz").alias("birthdate"),
                        F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"),
                        F.col("r_name").alias("region")))

    @cached_property
    def targets(self) -> DataFrame:
        return scan_targets(self.driver.spark, BRANDS)

    @cached_property
    def folds(self) -> DataFrame:
        return FO.grouped_folds(self.scope)

    @cached_property
    def scores(self) -> DataFrame:
        """Two deterministic models over all (subject, brand) pairs, with labels and folds.

        Model a scores by all earlier purchases of the brand, model b by those of the last year; each
        also looks at another brand, so that they differ for brands never bought, and both fall
        with the time since the last event. Subjects outside the folds have fold -1.
        """
        return self.stored("scores", self._scores)

    def _scores(self) -> DataFrame:
        # One row a subject, with one entry a brand it bought, from one pass over the cells; rows are multiplied by the targets after the last shuffle.
        cells = FE.event_cells(self.usable, self.examples, self.feature_cfg)
        rolled = FE.nested_counts(cells, self.examples, self.feature_cfg, [F.max("last_ts").alias("last")])
        brand = F.when(F.col("token").startswith("ITEM_"), F.struct(
            F.substring_index("token", "_", -1).alias("code"), F.struct("n_365d", "n_ever").alias("n")))
        mine = rolled.groupBy("subject_id").agg(F.max("last").alias("last"), F.map_from_entries(F.collect_list(brand)).alias("_n"))
        pairs = (self.labels.select("subject_id", "cutoff", "split", "code", "y", "prevalent", "at_risk")
                 .join(mine, "subject_id", "left").join(self.folds, "subject_id", "left"))
        number = F.substring_index("code", "#", -1).cast("int")
        count = lambda n, step=0: F.coalesce(F.col("_n")[  # noqa: E731  (counts of the brand ``step`` after)
            F.concat(F.lit("Brand#"), (F.pmod(number - 1 + step, F.lit(25)) + 1).cast("string"))][n], F.lit(0))
        years = F.coalesce(FE.days_between(F.col("last"), F.col("cutoff")), F.lit(3650.0)) / 365.25
        score = lambda n, step: F.round(sigmoid(F.lit(-2.0) + 0.3 * count(n) + 0.2 * count("n_ever", step) - 0.1 * years), 6)
        models = F.explode(F.array(F.struct(F.lit("a").alias("model"), score("n_ever", 1).alias("p")),
                                   F.struct(F.lit("b").alias("model"), score("n_365d", 3).alias("p"))))
        return pairs.select("subject_id", "split", "code", "y", "prevalent", "at_risk",
                            F.coalesce("fold", F.lit(-1)).alias("fold"), models.alias("m")).select(
            "*", "m.model", "m.p").drop("m")


class Activity(Timeline):
    name = "activity"
    inputs = ("events",)
    spec = TimelineSpec(Span(7, "day"), "view", KINDS_B, ("signup",), "purchase", ("device",))
    example_cfg = ExampleConfig(Span(7, "day"), Span(7, "day"), 10, ("train",))
    feature_cfg = FeatureConfig(windows=(1.0, 7.0), rate_window=3.0, cap_days=30.0, shape_kinds=KINDS_B, n_common=5)
    sequence_cfg = SequenceConfig(block_size=32, min_events_per_bin=12, text_answers=True)

    @cached_property
    def raw(self) -> DataFrame:
        """Raw rows in source form: value as text with a declared type, reason codes as floats."""
        ev = self.driver.table("events")
        k = F.get_json_object("props", "$.k").cast("int")
        kind = F.col("event_type")
        ts = F.when(kind == "signup", F.col("ts").cast("date").cast("timestamp_ntz")).otherwise(F.col("ts"))
        text = kind == "error"
        answer = F.concat(F.lit(" code-"), F.floor(k / 25).cast("string"), F.lit(" "))
        return ev.select(
            F.col("user_id"), ts.alias("ts"), kind.alias("event_type"), (k % 10).cast("string").alias("code"),
            F.when(text, answer).otherwise(F.col("value").cast("string")).alias("value"),
            F.when(text, "text").otherwise("numeric").alias("value_type"),
            F.when(kind == "click", F.lit("n/a"))
            .otherwise(F.concat(F.floor(k / 10).cast("string"), F.lit(".0"))).alias("reason"),
            (F.col("value") * 2).alias("cost"),
        )

    def spec_of(self, kind: str) -> TableSpec:
        return TableSpec(kind, kind, "ts", "code", "user_id", reason="reason", value="value",
                         value_type="value_type", costs=("cost",))

    @cached_property
    def tables(self) -> list[DataFrame]:
        """All kinds lie in one file, which is read once."""
        return [scan_event_table(self.raw.filter(F.col("event_type").isin(*KINDS_B)), self.spec_of("any"), "event_type")]

    @cached_property
    def visits(self) -> DataFrame:
        """Every activity counts as contact; the anchor comes from the last of any kind."""
        return self.raw.select(F.col("user_id").alias("subject_id"), "ts",
                               F.lit(None).cast("timestamp_ntz").alias("stop"))

    @cached_property
    def answers(self) -> DataFrame:
        return scan_text_answers(self.raw.filter(F.col("event_type") == "error"), self.spec_of("error"))

    @cached_property
    def subjects(self) -> DataFrame:
        key = F.col("subject_id")
        return self.visits.select("subject_id").distinct().select(
            key, F.make_date((1950 + key % 50).cast("int"), (1 + key % 12).cast("int"), F.lit(1))
            .cast("timestamp_ntz").alias("birthdate"),
            F.when(key % 7 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("d"), (key % 3).cast("string"))).alias("device"))

    @cached_property
    def targets(self) -> DataFrame:
        return scan_targets(self.driver.spark, CODES_B)
