"""The data model of this package, derived from the star-schema test tables.

Customers act as samples, parts as sequence variants, line quantities as reads, events as
trace spans and conversations as chat messages.  Derived tables are written once per
application into the shared folder, in the layout that the ingest job also uses, and are
read from there by every query.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.cluster import in_parallel, scratch_path, settle
from pelagia.contracts import (CONTEXT_COLUMNS, GENERAL_SCHEMA, MARKERS, METADATA_COLUMNS, SOURCES,
                               STAT_SCHEMA)
from pelagia.functions.text import title
from pelagia.operators.ordering import numbered
from pelagia.plans.preprocess import preprocess
from pelagia.sources.storage import data_files, exists
from pelagia.sources.store import Store, of_marker, write_table
from pelagia.sources.tsv import write_tsv

TABLES = ("region", "nation", "customer", "part", "orders", "lineitem", "events",
          "conversations")
_ROOTS: dict[tuple, str] = {}

SAMPLE_ID = "concat('TARA_', lpad(cast({key} as string), 10, '0'))"

CONTEXT_EXPRESSIONS = {
    "sample_id_pangaea": SAMPLE_ID.format(key="c_custkey"),
    "sample_id_biosamples": "concat('SAMEA', c_custkey)",
    "sample_id_ena": "concat('ERS', c_custkey)",
    "sample_material": "c_mktsegment",
    "event_date": "first_order",
    "event_latitude": "cast(c_custkey % 181 - 90 as double)",
    "event_longitude": "cast(c_custkey * 7 % 361 - 180 as double)",
    "depth_nominal": "if(c_custkey % 5 = 0, '0-100', cast(c_custkey % 1000 as string))",
    "marine_biome": "concat(r_name, ' Biome')",
    "ocean_region": "concat('[', substr(r_name, 1, 2), '] ', r_name)",
    "biogeo_province": "concat(r_name, '/', n_name)",
    "station": "n_name",
    "depth": "case c_mktsegment when 'BUILDING' then 'SRF' when 'AUTOMOBILE' then 'DCM' "
             "when 'MACHINERY' then 'MES' when 'HOUSEHOLD' then 'MIX' else 'FSW' end",
    "size_fraction": "if(c_custkey % 11 = 0, null, case c_nationkey % 3 when 0 then '0.8-5' "
                     "when 1 then '5-20' else '20-180' end)",
    "lower_size_fraction": "cast(case c_nationkey % 3 when 0 then 0.8 when 1 then 5 else 20 end "
                           "as double)",
    "upper_size_fraction": "cast(if(c_custkey % 13 = 0, null, case c_nationkey % 3 when 0 then 5 "
                           "when 1 then 20 else 180 end) as double)",
    "depthplot": "if(c_custkey % 17 = 0, null, c_mktsegment)",
    "sizeplot": "if(c_custkey % 19 = 0, null, case c_nationkey % 3 when 0 then 'pico' "
                "when 1 then 'nano' else 'micro' end)",
    "station_plot": "n_name",
    "biomeplot": "r_name",
    "polar": "if(abs(c_custkey % 181 - 90) >= 60, 'Polar', 'Non polar')",
    "abs_lat": "cast(abs(c_custkey % 181 - 90) as double)",
    "uniq": "if(c_custkey % 2 = 0, 'yes', 'no')",
    "complete": "if(c_custkey % 3 = 0, 'no', 'yes')",
    "coral_station": "if(c_custkey % 29 = 0, 'yes', 'no')",
    "par": "if(c_custkey % 23 = 0, null, c_acctbal / 100)",
    "depth_bathy": "cast(-(c_custkey % 5000) as int)",
    "lyapunov_exp": "cast(c_custkey % 97 as double) / 100",
    "temperature": "if(c_custkey % 7 = 0, null, c_acctbal)",
    "chla": "if(c_custkey % 9 = 0, null, cast(c_custkey % 211 as double) / 50)",
    "backscattering": "cast(c_custkey % 53 as double) / 1000",
    "depth_chl_max": "if(c_custkey % 10 = 3, null, cast(c_custkey % 150 as int))",
    "mixed_layer_depth_sigma": "cast(c_custkey % 200 as int)",
    "depth_max_brunt_väisälä": "if(c_custkey % 8 = 1, null, cast(c_custkey % 300 as int))",
    "nitrite": "cast(c_custkey % 101 as double) / 10",
    "phosphate": "cast(c_custkey % 37 as double) / 10",
    "nitrate_nitrite": "if(c_custkey % 6 = 5, null, cast(c_custkey % 43 as double) / 10)",
    "silicate": "cast(c_custkey % 59 as double) / 10",
    "nstar": "cast(c_custkey % 41 - 20 as double) / 2",
}

SPAN_COLUMNS = {
    "kind": "case when sequence_no = 0 then 'workflow' else case event_type when 'view' then "
            "'node' when 'click' then 'tool' when 'purchase' then 'llm' else 'data' end end",
    "status": "case when event_type = 'error' then 'failed' when event_id % 37 = 0 then 'running' "
              "else 'completed' end",
}


class Binding:
    """Lazily prepared tables for one folder of test data."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        state = tuple((f.path, f.size, f.modified_ms)
                      for t in TABLES for f in data_files(spark, self.path(t)))
        key = (spark.sparkContext.applicationId, state)
        if key not in _ROOTS:
            _ROOTS[key] = scratch_path(spark, "prepared")
        self.root = _ROOTS[key]

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.parquet"

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def location(self, name: str) -> str:
        """Path of a prepared table; written on first use."""
        path = f"{self.root}/{name}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            frame, by, order = getattr(self, f"_build_{name}")()
            write_table(frame, path, by, order)
        return path

    def prepare(self) -> None:
        """Write all derived tables, those that do not depend on each other side by side."""
        for wave in (("context", "counts", "sessions", "messages", "spans"),
                     ("metadata", "marker_samples", "traces")):
            in_parallel(self.spark, *[partial(self.location, name) for name in wave])
        self.tsv_folder()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.location(name))

    # -- samples and counts ------------------------------------------------------------

    def context(self) -> DataFrame:
        return self.table("context")

    def general(self) -> DataFrame:
        """The first raw context source, still with its date as text."""
        text_date = F.date_format("event_date", "yyyy-MM-dd'T'HH:mm:ss").alias("event_date")
        return self.context().select(*[text_date if c == "event_date" else c
                                       for c in GENERAL_SCHEMA.names])

    def stat(self) -> DataFrame:
        return self.context().select(*STAT_SCHEMA.names)

    def cells(self, marker: str | None = None) -> DataFrame:
        """Long sparse counts: marker, amplicon, sample_id, reads > 0."""
        return of_marker(self.table("counts").filter("reads > 0"), marker)

    def metadata(self, marker: str | None = None) -> DataFrame:
        return of_marker(self.table("metadata"), marker)

    def marker_samples(self, marker: str | None = None) -> DataFrame:
        return of_marker(self.table("marker_samples"), marker)

    def _build_context(self):
        first = self.raw("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
        people = (self.raw("customer")
                  .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
                  .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
                  .join(first, F.col("c_custkey") == F.col("o_custkey"), "left"))
        frame = people.select(*[F.expr(CONTEXT_EXPRESSIONS[c]).alias(c) for c in CONTEXT_COLUMNS])
        return frame, [], ["sample_id_pangaea"]

    def _build_counts(self):
        lines = self.raw("lineitem").select(
            "l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("quantity"),
            F.expr("case l_linestatus when 'O' then 'v4' when 'F' then 'v9' end").alias("marker"))
        owners = self.raw("orders").select("o_orderkey", "o_custkey").hint("shuffle_hash")
        counted = (lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
                   .filter("(marker = 'v4' and o_custkey % 10 < 7) or "
                           "(marker = 'v9' and o_custkey % 10 between 3 and 8)")
                   .select("marker", "l_partkey", "o_custkey", "quantity").repartition("marker", "l_partkey", "o_custkey")
                   .groupBy("marker", "l_partkey", "o_custkey")
                   .agg(F.sum(F.expr("if(o_custkey % 97 = 0, 0L, quantity)")).alias("reads")))
        # Few lines share a key, so they are not added up before the shuffle; and the range bounds are sampled from what is added up once.
        path = scratch_path(self.spark, "counted")
        counted.write.option("compression", "zstd").parquet(path)
        frame = self.spark.read.schema(counted.schema).parquet(path).select("marker", F.md5(F.col("l_partkey").cast("string")).alias("amplicon"),
                               F.expr(SAMPLE_ID.format(key="o_custkey")).alias("sample_id"), "reads")
        return frame, ["marker"], ["sample_id", "amplicon"]

    def _build_metadata(self):
        stored = self.cells().groupBy("marker", "amplicon").agg(
            F.sum("reads").alias("total"), F.count(F.lit(1)).alias("spread"))
        parts = (self.raw("part").withColumn("amplicon", F.md5(F.col("p_partkey").cast("string")))
                 .withColumn("marker", F.explode(F.array(F.lit("v4"), F.lit("v9")))))
        frame = parts.join(stored, ["marker", "amplicon"], "left").selectExpr(
            "marker", "amplicon",
            "concat('Root;Eukaryota;', p_type, ';', p_brand, ';', p_name) as taxonomy",
            "concat('100;99;98;97;', p_size) as confidence",
            "coalesce(total, 0L) as total", "coalesce(spread, 0L) as spread",
            "translate(amplicon, '0123456789abcdef', 'ACGTACGTACGTACGT') as sequence")
        return frame, ["marker"], ["amplicon"]

    def _build_marker_samples(self):
        pairs = self.table("counts").select("marker", "sample_id").distinct()
        return numbered(pairs, ["marker"], ["sample_id"], "ordinal"), ["marker"], ["ordinal"]

    # -- raw tab-separated sources -------------------------------------------------------

    def tsv_folder(self) -> str:
        """The four raw sources, written by Spark from the tables; one row per customer or part.

        A matrix has one column per (nation, segment), named after that group's first
        customer: its width does not grow with the data, as a header line requires.
        """
        folder = f"{self.root}/tsv"
        if not exists(self.spark, f"{folder}/{SOURCES['18s_v9'][0]}/_SUCCESS"):
            write_tsv(self.general(), f"{folder}/{SOURCES['context_general'][0]}")
            write_tsv(self.stat(), f"{folder}/{SOURCES['context_stat'][0]}")
            self._write_matrices(folder)
        return folder

    def _write_matrices(self, folder: str) -> None:
        people = self.raw("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        groups = people.groupBy("c_nationkey", "c_mktsegment").agg(
            F.expr(SAMPLE_ID.format(key="min(c_custkey)")).alias("sample_id"))
        columns = settle(numbered(groups, [], ["sample_id"], "place"))
        names = [r.sample_id for r in columns.orderBy("place").collect()]  # one header line
        owners = (self.raw("orders").select("o_orderkey", "o_custkey")
                  .join(people, F.col("o_custkey") == F.col("c_custkey"))
                  .join(F.broadcast(columns), ["c_nationkey", "c_mktsegment"])
                  .select("o_orderkey", "place").hint("shuffle_hash"))  # the lines are not sorted
        rows = self._matrix_rows(owners)
        parts = self.raw("part").withColumn(
            "marker", F.explode(F.array(F.lit("v4"), F.lit("v9"))))
        full = parts.join(rows, [parts["marker"] == rows["marker"],
                                 F.col("p_partkey") == F.col("l_partkey")], "left").drop(rows["marker"])
        # Each count is preceded by a zero for every column that it skips.
        text = F.expr(f"""concat(
            array_join(transform(coalesce(counts, array()), (c, i) -> concat(
              repeat('\t0', cast(c.place - coalesce(get(counts, i - 1).place, -1) - 1 as int)),
              '\t', c.reads)), ''),
            repeat('\t0', cast({len(names)} - 1 - coalesce(array_max(counts).place, -1) as int)))""")
        key = F.md5(F.col("p_partkey").cast("string"))
        line = F.concat(F.concat_ws(
            "\t", key, F.expr("concat('Root;Eukaryota;', p_type, ';', p_brand, ';', p_name)"),
            F.expr("concat('100;99;98;97;', p_size)"),
            F.coalesce("total", F.lit(0)).cast("string"), F.coalesce("spread", F.lit(0)).cast("string"),
            F.translate(key, "0123456789abcdef", "ACGTACGTACGTACGT")), text)
        header = "\t".join([*METADATA_COLUMNS, *names])
        lines = full.select("marker", line.alias(header))
        for marker in MARKERS:
            (lines.filter(F.col("marker") == marker).select(F.col(f"`{header}`"))
             .write.mode("overwrite").option("header", "true").option("sep", "\u0001")
             .option("quote", "").csv(f"{folder}/{SOURCES[f'18s_{marker}'][0]}"))

    def _matrix_rows(self, owners: DataFrame) -> DataFrame:
        """marker, l_partkey, counts (place, reads), total and spread, from the lines of the owners' orders."""
        counted = (self.raw("lineitem").select(
            "l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("reads"),
            F.expr("case l_linestatus when 'O' then 'v4' when 'F' then 'v9' end").alias("marker"))
            .join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
            # One shuffle serves both aggregations and the join with the parts.
            .select("marker", "l_partkey", "place", "reads").repartition("marker", "l_partkey")
            .groupBy("marker", "l_partkey", "place").agg(F.sum("reads").alias("reads")))
        return counted.groupBy("marker", "l_partkey").agg(
            F.array_sort(F.collect_list(F.struct("place", "reads"))).alias("counts"),
            F.sum("reads").alias("total"), F.count_if(F.col("reads") > 0).alias("spread"))

    def store(self) -> Store:
        """The published form of the raw sources."""
        target = f"{self.root}/processed"
        preprocess(self.spark, self.tsv_folder(), target, enforce_shape=False)
        return Store(self.spark, target)

    # -- conversations and traces --------------------------------------------------------

    def sessions(self) -> DataFrame:
        return self.table("sessions")

    def messages(self) -> DataFrame:
        return self.table("messages")

    def spans(self) -> DataFrame:
        return self.table("spans")

    def traces(self) -> DataFrame:
        return self.table("traces")

    def _build_sessions(self):
        base = "timestamp_ntz'2024-01-01 00:00:00'"
        frame = self.raw("conversations").groupBy("conv_id").agg(
            F.min_by("text", "turn").alias("question")).select(
            F.col("conv_id").alias("session_id"), F.expr("conv_id % 5").alias("user_id"),
            title(F.col("question")).alias("title"), F.lit("active").alias("status"),
            F.expr(f"if(conv_id % 6 = 0, {base} + make_dt_interval(0, cast(conv_id % 17 as int)), "
                   "null)").alias("pinned_at"),
            F.expr(f"{base} + make_dt_interval(0, cast(conv_id % 8760 as int))").alias("updated_at"))
        return frame, [], ["session_id"]

    def _build_messages(self):
        turns = self.raw("conversations").select(
            F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"),
            F.expr("concat(conv_id, '-202401', lpad(cast(turn % 28 + 1 as string), 2, '0'))")
            .alias("trace_id"))
        frame = numbered(turns, ["session_id"], ["turn"], "sequence_no")
        return frame.withColumn("message_id", F.expr("concat(session_id, '/', sequence_no)")), \
            [], ["session_id", "sequence_no"]

    def _build_spans(self):
        events = self.raw("events").withColumn(
            "trace_id", F.expr("concat(user_id, '-', date_format(ts, 'yyyyMMdd'))"))
        rows = numbered(events, ["trace_id"], ["ts", "event_id"], "sequence_no")
        rows = (rows.withColumn("status", F.expr(SPAN_COLUMNS["status"]))
                .withColumn("span_kind", F.expr(SPAN_COLUMNS["kind"]))
                .withColumn("duration_ms", F.expr("cast(bround(value * 10, 0) as bigint)")))
        frame = rows.selectExpr(
            "trace_id", "concat(trace_id, '#', sequence_no) as span_id",
            "if(sequence_no = 0, null, concat(trace_id, '#', (sequence_no - 1) div 2)) "
            "as parent_span_id",
            "sequence_no", "concat(event_type, ' ', event_id) as name", "span_kind", "status",
            "ts as started_at",
            "if(status = 'running', null, ts + make_dt_interval(0, 0, 0, "
            "cast(duration_ms as decimal(18,6)) / 1000)) as ended_at",
            "if(status = 'running', null, duration_ms) as duration_ms",
            "if(status = 'failed', 'OperationError', null) as error_code",
            "if(status = 'failed', concat('password=', md5(cast(event_id as string))), null) "
            "as error_message",
            "if(span_kind = 'tool', concat('tool_', event_id % 6), null) as tool_name",
            "map('event_type', event_type, 'k', get_json_object(props, '$.k')) as filters",
            "transform(sequence(0, cast(event_id % 3 as int)), i -> "
            "concat('source_', (event_id + i) % 4, '.tsv')) as source_files",
            "props as output_data", "event_id")
        return frame, [], ["trace_id", "sequence_no"]

    def _build_traces(self):
        frame = self.spans().groupBy("trace_id").agg(
            F.min("started_at").alias("started_at"),
            F.max("ended_at").alias("last_end"), F.count(F.lit(1)).alias("span_count"),
            F.max(F.col("status") == "failed").alias("any_failed"),
            F.max(F.col("status") == "running").alias("any_running")).selectExpr(
            "trace_id", "cast(split_part(trace_id, '-', 1) as bigint) as session_id", "started_at",
            "case when any_failed then 'failed' when any_running then 'running' "
            "else 'completed' end as status",
            "if(any_failed or not any_running, last_end, null) as ended_at", "span_count",
            """concat('{"question":"What happened in ', trace_id, '?"}') as input_data""",
            """if(any_failed or any_running, null, if(span_count % 2 = 0, concat('{"answer":"',
               span_count, ' steps","result":{"metadata":{"provenance":{"sample_count":',
               span_count, '}}}}'), concat('{"answer":"', span_count, ' steps"}'))) as output_data""")
        return frame, [], ["trace_id"]
