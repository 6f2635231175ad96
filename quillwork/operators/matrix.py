"""Benchmark matrices: medians, agreement across clients, pivots, ratios, quarantine, energy."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Published energy costs in nanojoules a byte.
NJ_PER_BYTE = {
    "json_parse": 1.8, "json_serialise": 2.1, "gzip_compress": 0.9, "gzip_decompress": 0.15, "bpe_tokenise": 14.0, "bpe_detokenise": 6.0, "msgpack_encode": 2.1, "msgpack_decode": 2.1,
    "lan_egress": 10.0, "lan_ingress": 10.0, "internet_backbone_per_hop": 50.0,
}
NETWORK = ("gzip_compress", "lan_egress", "internet_backbone_per_hop", "lan_ingress", "gzip_decompress")
TEXT_HOP = ("json_serialise", "bpe_tokenise", *NETWORK, "bpe_detokenise", "json_parse")
ID_HOP = ("msgpack_encode", *NETWORK, "msgpack_decode")
REQUESTS_PER_DAY, KG_CO2_PER_KWH, TONNES_PER_CAR = 5_000_000_000, 0.37, 4.6


def medians(rows: DataFrame, cell: list[str], values: list[str]) -> DataFrame:
    return rows.groupBy(*cell).agg(*[F.median(v).alias(v) for v in values], F.count("*").alias("n_reps"))


def client_medians(rows: DataFrame, cell: list[str], client: str, values: list[str]) -> DataFrame:
    """A row for each client of a cell: medians of its runs, and its number of errors."""
    return rows.groupBy(*cell, client).agg(*[F.median(v).alias(v) for v in values], F.count("error").alias("errors"))


def unanimity(clients: DataFrame, cell: list[str]) -> DataFrame:
    """Whether all clients of a cell, a row each, saw the same bytes, and the same tokens without any error."""
    return clients.groupBy(*cell).agg(
        (F.count_distinct("wire_bytes") == 1).alias("wire_unanimous"),
        ((F.count_distinct("tokens") == 1) & (F.sum("errors") == 0)).alias("decode_unanimous"),
        F.count("*").alias("n_rows"),
    )


def pivot_grid(rows: DataFrame, cell: list[str], encodings: list[str], value: str) -> DataFrame:
    return rows.groupBy(*cell).pivot("encoding", encodings).agg(F.min(value))


def headline(rows: DataFrame, baseline: Column, value: str) -> DataFrame:
    """rows with ratio: the baseline cell's value of the same engine over theirs."""
    base = rows.filter(baseline).groupBy("engine").agg(F.min(value).alias("_base"))
    return rows.join(base, "engine", "left").withColumn("ratio", F.col("_base") / F.col(value)).drop("_base")


def synthetic_headline(rows: DataFrame) -> DataFrame:
    """identity against the smallest encoding, for rows(corpus, format, encoding, wire_bytes)."""
    grid = rows.groupBy("corpus", "format").agg(F.min(F.when(F.col("encoding") == "identity", F.col("wire_bytes"))).alias("identity"), F.min("wire_bytes").alias("best"))
    return grid.withColumn("ratio", F.col("identity") / F.col("best"))


def quarantine(rows: DataFrame) -> DataFrame:
    """Rows whose fingerprint differs from the first of their engine."""
    first = rows.groupBy("engine").agg(F.min_by("fingerprint", "run_id").alias("canonical"))
    return rows.join(first, "engine").filter(F.col("fingerprint") != F.col("canonical"))


def errored(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("error").isNotNull())


def efficiency(rows: DataFrame) -> DataFrame:
    """Against the identity cell of the same size: interactive (bytes times first byte), batch, and the two coefficients."""
    base = rows.filter("encoding = 'identity'").groupBy("size").agg(F.min("wire_bytes").alias("_w"), F.min("ttft_ms").alias("_t"))
    joined = rows.join(base, "size")
    wire, ttft = F.col("wire_bytes") / F.col("_w"), F.col("ttft_ms") / F.col("_t")
    return joined.withColumns({"wire_coeff": wire, "ttft_ratio": ttft, "interactive": 1 / (wire * ttft), "batch": 1 / wire}).drop("_w", "_t")


def hop_mj(payload: Column, steps: tuple[str, ...]) -> Column:
    return payload * (sum(NJ_PER_BYTE[s] for s in steps) * 1e-6)


def energy(rows: DataFrame) -> DataFrame:
    """rows(text_bytes, id_bytes, round_trips) with the energy of either path, their ratio, and a year's kilowatt hours saved."""
    text, ids = hop_mj(F.col("text_bytes"), TEXT_HOP), hop_mj(F.col("id_bytes"), ID_HOP)
    out = rows.withColumns({"text_mj": text * F.col("round_trips"), "ids_mj": ids * F.col("round_trips") + hop_mj(F.col("id_bytes"), ("bpe_detokenise",))})
    saved = (F.col("text_mj") - F.col("ids_mj")) * (REQUESTS_PER_DAY * 365 / 1e12) * 277.778
    return out.withColumns({"ratio": F.col("text_mj") / F.greatest(F.col("ids_mj"), F.lit(1e-9)), "kwh_saved": saved, "cars": saved * KG_CO2_PER_KWH / 1000 / TONNES_PER_CAR})


def fingerprint(methodology: dict, excluded: tuple[str, ...] = ("fingerprint", "run_id", "captured_at")) -> str:
    """SHA-256 over the methodology without what may differ, keys sorted."""
    kept = {k: v for k, v in methodology.items() if k not in excluded}
    return "sha256:" + hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def human_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(F.format_number(n / 1024, 1), F.lit(" KB"))).otherwise(F.concat(F.format_number(n / (1 << 20), 1), F.lit(" MB")))


def load_results(spark, path: str) -> DataFrame:
    """Rows of result documents {schema_version, methodology, rows} below path; other kinds and versions are left out."""
    rows = "array<struct<size:int,format:string,encoding:string,wire_bytes:long,ttft_ms:double,total_ms:double,tokens_emitted:long,error:string>>"
    schema = f"schema_version int, methodology struct<engine:string,language:string,fingerprint:string>, rows {rows}"
    docs = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    docs = docs.withColumn("file", F.col("_metadata.file_path")).filter((F.col("schema_version") == 1) & F.col("rows").isNotNull())
    return docs.select("file", "methodology.engine", "methodology.language", "methodology.fingerprint", F.explode("rows").alias("r")).select("file", "engine", "language", "fingerprint", "r.*")


def crossover(rows: DataFrame) -> DataFrame:
    """(path, encoding, wins, losses): sizes at which an encoding is the smallest of rows(path, size, encoding, wire_bytes), and is over a fifth above that."""
    best = rows.groupBy("path", "size").agg(F.min(F.struct("wire_bytes", "encoding")).alias("b"))
    joined = rows.join(best, ["path", "size"])
    sizes = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("size"))))
    return joined.groupBy("path", "encoding").agg(sizes(F.col("encoding") == F.col("b.encoding")).alias("wins"), sizes(F.col("wire_bytes") > F.col("b.wire_bytes") * 1.2).alias("losses"))


def throughput(rows: DataFrame) -> DataFrame:
    """(language, median_ms, p99_ms, tokens_per_sec) from rows(language, tokens, ms), one row a repetition."""
    out = rows.groupBy("language").agg(F.median("ms").alias("median_ms"), F.percentile("ms", 0.99).alias("p99_ms"), F.max("tokens").alias("_n"))
    return out.withColumn("tokens_per_sec", F.col("_n") / F.col("median_ms") * 1000).drop("_n")


def not_applicable(rows: DataFrame) -> DataFrame:
    """rows(server_knows_formats, format, ...) with applicable: a server that ignores the format answers JSON only."""
    return rows.withColumn("applicable", F.col("server_knows_formats") | (F.col("format") == "json"))
