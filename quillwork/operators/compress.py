"""Content-encoding choice, entropy, dictionaries and compressed sizes."""

from __future__ import annotations

import contextlib
import gzip
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


KNOWN = ("gzip", "br", "zstd", "identity")
# Time-to-first-byte ratios of the stack profiles, and the picker's limits.
PROFILES = {"default": {"gzip": 1.0, "br": 1.0, "zstd": 1.0}, "sglang": {"gzip": 1.0, "br": 1.0, "zstd": 1.0}, "llama.cpp": {"gzip": 1.0, "br": 1.0, "zstd": 1.0}}
MAX_TTFT_RATIO, LOW_ENTROPY = 5.0, 3.0
PREFERENCE = ("dict-zstd", "zstd", "br", "gzip", "identity")


def accept_encoding(header: Column) -> Column:
    """Known encodings a header accepts, by falling quality and then place; identity is implied unless forbidden."""
    parts = F.filter(F.transform(F.split(header, ","), lambda p: F.trim(p)), lambda p: p != "")
    parsed = F.transform(
        parts,
        lambda p, i: F.struct(
            F.lower(F.trim(F.substring_index(p, ";", 1))).alias("name"),
            F.coalesce(F.regexp_extract(p, r";\s*q\s*=\s*([0-9.]+)\s*(?:;|$)", 1).try_cast("double"), F.lit(1.0)).alias("q"),
            i.alias("i"),
        ),
    )
    wanted = F.filter(parsed, lambda e: (e["q"] > 0) & e["name"].isin(*KNOWN))
    ordered = F.array_sort(F.transform(wanted, lambda e: F.struct((-e["q"]).alias("nq"), e["i"].alias("i"), e["name"].alias("name"))))
    names = F.array_distinct(F.transform(ordered, lambda e: e["name"]))
    star_off = F.exists(parsed, lambda e: (e["name"] == "*") & (e["q"] == 0))
    forbidden = F.exists(parts, lambda p: p.rlike(r"(?i)^identity\s*;\s*q\s*=\s*0")) | (star_off & (F.size(names) == 0))
    full = F.when(forbidden | F.array_contains(names, "identity"), names).otherwise(F.array_append(names, F.lit("identity")))
    return F.when(header.isNull() | (F.size(parts) == 0), F.array(F.lit("identity"))).otherwise(full)


def pick(header: Column, has_dict: Column, enabled: Column, entropy: Column, stack: Column | None = None, profiles: dict[str, dict[str, float]] | None = None) -> Column:
    """struct(encoding, reason_code, considered) of the encoding for a response; entropy null: no sample."""
    profiles = profiles or PROFILES
    stack = F.coalesce(stack if stack is not None else F.lit("default"), F.lit("default"))

    def ratio(enc: str) -> Column:
        out = F.lit(profiles["default"].get(enc, 1.0))
        for name, p in profiles.items():
            out = F.when(stack == name, p.get(enc, 1.0)).otherwise(out)
        return out

    accepted = accept_encoding(header)
    has = {e: F.array_contains(accepted, e) for e in KNOWN}
    dropped = F.when(~has["zstd"], "gzip_no_zstd_in_accept").when(~has_dict, "gzip_no_dict").when(~enabled, "gzip_middleware_disabled")
    slow = {e: ratio(e) > MAX_TTFT_RATIO for e in ("zstd", "br", "gzip")}
    zstd_ok = has["zstd"] & has_dict & enabled
    left = {"zstd": zstd_ok & ~slow["zstd"], "br": has["br"] & ~slow["br"], "gzip": has["gzip"] & ~slow["gzip"], "identity": has["identity"]}

    def out(encoding: str, reason: Column | str) -> Column:
        return F.struct(F.lit(encoding).alias("encoding"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason_code"))

    chosen = (
        F.when(F.coalesce(entropy < LOW_ENTROPY, F.lit(False)) & left["br"] & left["zstd"], out("br", "br_content_sample_low_entropy"))
        .when(left["zstd"], out("zstd", "dict_zstd_default"))
        .when(zstd_ok & slow["zstd"] & left["gzip"], out("gzip", "per_stack_overrode_zstd"))
        .when(left["gzip"], out("gzip", F.coalesce(dropped, F.lit("gzip_no_zstd_in_accept"))))
        .when(left["br"], out("br", "br_fallback_no_gzip"))
        .otherwise(out("identity", "identity_last_resort"))
    )
    considered = F.array_sort(F.filter(F.array(*[F.when(c, e) for e, c in left.items()]), lambda e: e.isNotNull()))
    return F.struct(chosen["encoding"].alias("encoding"), chosen["reason_code"].alias("reason_code"), considered.alias("considered"))


def build_accept(zstd: bool = False, gzip_: bool = True, br: bool = True) -> str:
    return ", ".join(p for on, p in ((gzip_, "gzip;q=1.0"), (br, "br;q=0.5"), (zstd, "zstd;q=0.3")) if on)


def negotiate(client: Column, server: Column, tier: Column) -> Column:
    """struct(chosen, error): the most preferred encoding both support; identity is refused in production."""
    both = F.array_intersect(client, server)
    chosen = F.get(F.filter(F.array(*map(F.lit, PREFERENCE)), lambda p: F.array_contains(both, p)), F.lit(0))
    error = F.when(chosen.isNull(), "no algorithm in common").when((chosen == "identity") & (tier == "production"), "identity rejected in production")
    return F.struct(F.when(error.isNull(), chosen).alias("chosen"), error.alias("error"))


def byte_entropy(text: Column) -> Column:
    """Shannon entropy of a text's bytes in bits; 0 for an empty text, null for null.  Bytes are counted inside their row."""

    def bits(raw: str | None) -> float | None:
        if raw is None:
            return None
        counts = np.bincount(np.frombuffer(raw.encode("utf-8", "surrogatepass"), np.uint8)).astype(float)
        counts = counts[counts > 0]
        n = counts.sum()
        return float(np.log2(n) - (counts * np.log2(counts)).sum() / n) if n else 0.0

    return F.pandas_udf(lambda texts: texts.map(bits), T.DoubleType())(text)


def bucket(size: Column) -> Column:
    return F.when(size <= 300, "small").when(size <= 2048, "medium").otherwise("large")


def over_budget(chunks: DataFrame, stream: str, order: str, size: str, budget: int) -> DataFrame:
    """chunks with the running total of their stream and whether it exceeds the budget."""
    from pyspark.sql import Window

    upto = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("total", F.sum(size).over(upto)).withColumn("over", F.col("total") > budget)


def compressed_length(how: Callable[[bytes], bytes], data: Column) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: len(how(bytes(b))))

    return F.pandas_udf(run, T.LongType())(data)


def gzip_length(data: Column) -> Column:
    return compressed_length(lambda b: gzip.compress(b, 6, mtime=0), data)


def zstd_length(data: Column, level: int = 3, dictionary: bytes | None = None) -> Column:
    def make(b: bytes) -> bytes:
        how = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        return how.compress(b)

    return compressed_length(make, data)


def train_dictionaries(samples: DataFrame, sizes: tuple[int, ...] = (4096, 16384, 65536), seed: int = 7, most: int = 20_000) -> DataFrame:
    """(kind, dict_size, dictionary, baseline_avg, with_dict_avg, gain_pct) for each kind of samples(kind, data).

    A hash deals four fifths of the samples to training and holds out one fifth.  A
    dictionary needs few samples, so it is fitted on about `most` of a kind at most, in
    the order of the hash; baseline and gain are measured on all that are held out.
    """
    dealt = samples.select("kind", "data", F.xxhash64(F.lit(seed), "data").alias("_h"))
    held = F.pmod("_h", F.lit(5)) == 0
    sizes_of = dealt.filter(~held).groupBy(F.col("kind").alias("_k")).agg(F.count("*").alias("_n"))
    # A row a kind.
    share = F.shiftrightunsigned("_h", 1) / F.lit(float(1 << 63)) <= F.lit(float(most)) / F.col("_n")
    taken = dealt.filter(~held).join(F.broadcast(sizes_of), F.col("kind").eqNullSafe(F.col("_k"))).filter(share).select("kind", "data")

    def train(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size in sizes:
            with contextlib.suppress(zstandard.ZstdError):  # too few samples for a dictionary of this size
                out.append((group["kind"].iloc[0], size, zstandard.train_dictionary(size, sorted(map(bytes, group["data"]))).as_bytes()))
        return pd.DataFrame(out, columns=["kind", "dict_size", "dictionary"])

    trained = taken.groupBy("kind").applyInPandas(train, "kind string, dict_size long, dictionary binary")
    made = {(r.kind, r.dict_size): bytes(r.dictionary) for r in trained.collect()}  # len(sizes) a kind

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = zstandard.ZstdCompressor(level=3)
        with_ = {k: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d)) for k, d in made.items()}
        for batch in batches:
            rows = []
            for kind, data in zip(batch["kind"], batch["data"]):
                base = len(plain.compress(bytes(data)))
                rows += [(kind, size, base, len(how.compress(bytes(data)))) for (k, size), how in with_.items() if k == kind or k is kind]
            yield pd.DataFrame(rows, columns=["kind", "dict_size", "base", "with_dict"])

    sized = dealt.filter(held).select("kind", "data").mapInPandas(measure, "kind string, dict_size long, base long, with_dict long")
    means = sized.groupBy("kind", "dict_size").agg(F.avg("base").alias("baseline_avg"), F.avg("with_dict").alias("with_dict_avg"))
    table = samples.sparkSession.createDataFrame([(*k, bytearray(d)) for k, d in made.items()], "kind string, dict_size long, dictionary binary")
    out = table.join(means, ["kind", "dict_size"])
    return out.withColumn("gain_pct", 100 * (1 - F.col("with_dict_avg") / F.col("baseline_avg")))


def winners(trained: DataFrame) -> DataFrame:
    """The smallest dictionary within one point of the best gain, for each kind."""
    from pyspark.sql import Window

    near = trained.withColumn("_best", F.max("gain_pct").over(Window.partitionBy("kind"))).filter(F.col("gain_pct") >= F.col("_best") - 1)
    return near.groupBy("kind").agg(F.min("dict_size").alias("dict_size"))


def dict_hash(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def select_dictionary(responses: DataFrame, loaded: DataFrame) -> DataFrame:
    """responses(content_encoding, dict_hash, ...) with status: none, missing, malformed, unknown or ok, from loaded(hash)."""
    joined = responses.join(loaded.select(F.col("hash").alias("_h")).distinct(), F.col("dict_hash") == F.col("_h"), "left")
    status = (
        F.when(F.coalesce("content_encoding", F.lit("")) != "zstd", "none").when(F.col("dict_hash").isNull(), "missing")
        .when(~F.col("dict_hash").rlike("^sha256:[0-9a-f]{64}$"), "malformed").when(F.col("_h").isNull(), "unknown").otherwise("ok")
    )
    return joined.withColumn("status", status).drop("_h")
