"""The engine's queries over the test tables, and SQL that another engine answers the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, hashing
from ..operators import bitvector, evaluate, prefix, recsplit, retrieval, shockhash, shockrecsplit, sichash
from ..sources import keys as key_sources
from . import oracles as sql
from .persist import persist, shared_path

RECSPLIT = recsplit.Plan(bucket_size=100, leaf=8)
SICHASH = sichash.Plan()
SHOCKHASH = shockhash.Plan(bucket_size=20)
SHOCK_RECSPLIT = recsplit.Plan(bucket_size=40, leaf=12)
BIPARTITE = shockhash.Plan(bucket_size=20, bipartite=True)
LEAVES, SIZES = (4, 6, 8, 12), range(2, 400)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def customers(spark: SparkSession, d: str) -> DataFrame:
    return key_sources.distinct_keys(table(spark, d, "customer"), "c_name")


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return key_sources.distinct_keys(table(spark, d, "supplier"), "s_name")


def urls(spark: SparkSession, d: str) -> DataFrame:
    return key_sources.distinct_keys(table(spark, d, "pages"), "url")


def texts(spark: SparkSession, d: str) -> DataFrame:
    return key_sources.distinct_keys(table(spark, d, "documents"), "text")


CUSTOMERS = "SELECT DISTINCT c_name AS key FROM customer WHERE c_name IS NOT NULL"
SUPPLIERS = "SELECT DISTINCT s_name AS key FROM supplier WHERE s_name IS NOT NULL"
URLS = "SELECT DISTINCT url AS key FROM pages WHERE url IS NOT NULL"


def built_recsplit(keys: DataFrame, plan: recsplit.Plan = RECSPLIT) -> tuple[DataFrame, DataFrame, int]:
    keys = persist(keys, "keys")
    n = keys.count()
    return keys, persist(recsplit.build(keys, plan, n), "recsplit"), n


def recsplit_of(keys: DataFrame, plan: recsplit.Plan = RECSPLIT) -> DataFrame:
    keys, artifact, n = built_recsplit(keys, plan)
    return recsplit.lookup(keys, artifact, plan, n)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return recsplit_of(customers(spark, d))


# Hashing


def murmur32_keys(spark: SparkSession, d: str) -> DataFrame:
    return urls(spark, d).unionByName(customers(spark, d)).select("key", hashing.murmur32_of(F.col("key")).alias("m32"))


def murmur32_seeds(spark: SparkSession, d: str) -> DataFrame:
    seeds = [hashing.murmur32_of(F.col("key"), s).alias(f"m32_{s}") for s in (1, 7, 42)]
    return suppliers(spark, d).select("key", *seeds)


def murmur128_keys(spark: SparkSession, d: str) -> DataFrame:
    h = urls(spark, d).withColumn("h", hashing.murmur128_of(F.col("key"), 42))
    return h.select("key", hashing.hex64(F.col("h.h1")).alias("h1"), hashing.hex64(F.col("h.h2")).alias("h2"))


def murmur128_swapped(spark: SparkSession, d: str) -> DataFrame:
    h = urls(spark, d).withColumn("h", hashing.murmur128_swapped_of(F.col("key"), 42))
    return h.select("key", hashing.hex64(F.col("h.h1")).alias("h1"), hashing.hex64(F.col("h.h2")).alias("h2"))


def hash_family(spark: SparkSession, d: str) -> DataFrame:
    return suppliers(spark, d).select("key", F.posexplode(hashing.murmur32_family(F.col("key"), 5, 4)).alias("i", "h"))


def murmur64_keys(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).select("key", hashing.hex64(hashing.murmur64_of(F.col("key"), 42)).alias("m64"))


def ranges(spark: SparkSession, d: str) -> DataFrame:
    h = customers(spark, d).select("key", hashing.murmur32_of(F.col("key")).alias("h"), hashing.murmur128_of(F.col("key"), 42).alias("w"))
    return h.select(
        "key",
        hashing.fast_range16(F.col("h"), 31).alias("fast16"),
        F.pmod("h", F.lit(97)).alias("mod97"),
        hashing.fast_range64(F.col("w.h2"), 1000).alias("fast64"),
        hashing.mod_range(F.col("w.h1"), F.lit(101)).alias("mod101"),
        hashing.mod_range128(F.col("w.h1"), F.col("w.h2"), F.lit(103)).alias("wide103"),
    )


# Buckets and classes


def bucket_sizes(spark: SparkSession, d: str) -> DataFrame:
    sizes = recsplit.with_bucket(customers(spark, d), RECSPLIT, 16).groupBy("bucket").agg(F.count("*").alias("size"))
    return prefix.exclusive_prefix(sizes, "bucket", ["size"], block_bits=2)


def table_prefix(spark: SparkSession, d: str) -> DataFrame:
    return sichash.bucket_table(sichash.with_class(customers(spark, d), SICHASH, 8), SICHASH)


def class_assign(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d).select("key", sichash.choice_bits(F.col("key"), SICHASH).alias("bits"))
    return c.select("key", (F.col("bits") - 1).alias("class"), F.element_at(F.lit([2, 4, 8]), F.col("bits")).alias("n_hash"))


def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return class_assign(spark, d).groupBy("class").agg(F.count("*").alias("n"))


# Codecs


def quantities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.pmod(F.col("o_custkey"), F.lit(5000)).alias("value"), (F.pmod("o_orderkey", F.lit(8)) + 3).cast("int").alias("r"))


QUANTITIES = "SELECT o_orderkey AS id, o_custkey % 5000 AS value, (o_orderkey % 8 + 3)::INTEGER AS r FROM orders"


def golomb_encode(spark: SparkSession, d: str) -> DataFrame:
    coded = quantities(spark, d).withColumn("c", codecs.golomb_rice_encode(F.col("value"), F.col("r")))
    return coded.select("id", F.col("c.fixed").alias("fixed"), F.col("c.unary").alias("unary"))


def golomb_decode(spark: SparkSession, d: str) -> DataFrame:
    return golomb_encode(spark, d).select("id", codecs.golomb_rice_decode(F.col("fixed"), F.col("unary")).alias("value"))


def golomb_bits(spark: SparkSession, d: str) -> DataFrame:
    coded = golomb_encode(spark, d).withColumn("r", F.length("fixed"))
    return coded.groupBy("r").agg(F.sum(F.length("fixed") + F.length("unary")).alias("bits"))


def golomb_params_bijection(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 25).select(F.col("id").cast("int").alias("m"), codecs.bijection_parameter(F.col("id")).alias("param"))


def golomb_params_split(spark: SparkSession, d: str) -> DataFrame:
    parts = recsplit.fanout_table(spark, list(SIZES), list(LEAVES)).filter("size > leaf")
    return parts.select("size", "leaf", codecs.split_parameter(F.col("parts")).alias("param"))


def fanout_table(spark: SparkSession, d: str) -> DataFrame:
    return recsplit.fanout_table(spark, list(SIZES), list(LEAVES)).select("size", "leaf", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"))


def subtree_table(spark: SparkSession, d: str) -> DataFrame:
    return recsplit.subtree_table(spark, 400, 8)


def sequences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("g"), F.col("event_id").alias("value"))


SEQUENCES = "SELECT user_id AS g, event_id AS value FROM events"


def ef_encode(spark: SparkSession, d: str) -> DataFrame:
    return codecs.elias_fano_encode(sequences(spark, d), "g", "value", "value")


def ef_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return codecs.elias_fano_decode(ef_encode(spark, d), "g")


def ef_space(spark: SparkSession, d: str) -> DataFrame:
    return ef_encode(spark, d).select("g", codecs.elias_fano_space(F.col("n"), F.col("m"), F.col("l")).alias("bits"))


def golomb_wide(spark: SparkSession, d: str) -> DataFrame:
    """Round trips of values up to 2^62: those of orders, moved to the top of a long, with few bits in the unary part."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit((1 << 62) - 1).bitwiseXOR(F.col("o_custkey") * 524_287).alias("value"))
    coded = o.withColumn("c", codecs.golomb_rice_encode(F.col("value"), F.lit(57)))
    return coded.select("id", codecs.golomb_rice_decode(F.col("c.fixed"), F.col("c.unary")).alias("value"))


def bit_strings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    back = codecs.bits_to_int(codecs.bits_lsb_first(k))
    return table(spark, d, "orders").select(k.alias("id"), codecs.bits_lsb_first(k).alias("bits"), back.alias("back"), codecs.highest_bit(k).alias("highest"), codecs.log2_approx(k).alias("nearest"))


# Bit vectors


def event_bits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("pos"), (F.pmod("user_id", F.lit(3)) == 0).cast("int").alias("bit"))


EVENT_BITS = "SELECT event_id AS pos, (user_id % 3 = 0)::INTEGER AS bit FROM events"
WORDS = f"b AS ({EVENT_BITS}), w AS (SELECT pos // 64 AS word_no, bit_or(CASE WHEN bit = 1 THEN 1::UBIGINT << (pos % 64)::UBIGINT ELSE 0::UBIGINT END) AS word FROM b GROUP BY 1)"


def bit_pack(spark: SparkSession, d: str) -> DataFrame:
    return bitvector.pack_words(event_bits(spark, d)).select("word_no", hashing.hex64(F.col("word")).alias("word"))


def bit_unpack(spark: SparkSession, d: str) -> DataFrame:
    return bitvector.unpack_words(bitvector.pack_words(event_bits(spark, d))).groupBy("bit").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"))


def popcount_words(spark: SparkSession, d: str) -> DataFrame:
    return bitvector.pack_words(event_bits(spark, d)).select("word_no", bitvector.popcount(F.col("word")).alias("ones"))


def rank_bits(spark: SparkSession, d: str) -> DataFrame:
    return bitvector.with_rank(event_bits(spark, d)).select("pos", "rank", "rank_inclusive")


def select_ones(spark: SparkSession, d: str) -> DataFrame:
    return bitvector.select_ones(event_bits(spark, d))


def rank9_counts(spark: SparkSession, d: str) -> DataFrame:
    return bitvector.rank9_counts(bitvector.pack_words(event_bits(spark, d))).select("block", F.col("before").cast("long").alias("before"), hashing.hex64(F.col("inside")).alias("inside"))


def rank9_lookup(spark: SparkSession, d: str) -> DataFrame:
    words = bitvector.pack_words(event_bits(spark, d))
    return bitvector.rank9_at(words, event_bits(spark, d).select("pos"))


def select_inventory(spark: SparkSession, d: str) -> DataFrame:
    return bitvector.select_inventory(event_bits(spark, d))


def select_positions(spark: SparkSession, d: str) -> DataFrame:
    """The place of every 3rd one, of none, and of one beyond the last."""
    bits = event_bits(spark, d)
    return bitvector.select_at(bits, spark.range(0, bits.count() + 3, 3).withColumnRenamed("id", "r"))


def rank9_space(spark: SparkSession, d: str) -> DataFrame:
    words = persist(bitvector.pack_words(event_bits(spark, d)), "words")
    counts = bitvector.rank9_counts(words).agg(F.count("*").alias("blocks"))
    return words.agg(F.count("*").alias("words")).crossJoin(F.broadcast(counts)).select("words", "blocks", bitvector.rank9_space(F.col("words"), F.col("blocks")).alias("bits"))


# Retrieval


def _retrieval_space(keys: DataFrame, bits: int, method: str) -> DataFrame:
    pairs = persist(keys.select("key", F.pmod(hashing.murmur32_of(F.col("key")), F.lit(1 << bits)).alias("value")), "pairs")
    return retrieval.retrieval_space(retrieval.build_retrieval(pairs, bits, retrieval.n_shards(pairs.count(), 4096), method))


def ribbon_space(spark: SparkSession, d: str) -> DataFrame:
    return _retrieval_space(customers(spark, d), 1, "ribbon")


def burr_space(spark: SparkSession, d: str) -> DataFrame:
    return _retrieval_space(customers(spark, d), 2, "bumped")


def _retrieved(keys: DataFrame, bits: int, method: str) -> DataFrame:
    pairs = persist(keys.select("key", F.pmod(hashing.murmur32_of(F.col("key")), F.lit(1 << bits)).alias("value")), "pairs")
    shards = retrieval.n_shards(pairs.count(), 4096)
    epsilon = {"ribbon": 0.25, "bumped": 0.0}[method]
    artifact = persist(retrieval.build_retrieval(pairs, bits, shards, method), "retrieval")
    return retrieval.retrieve(pairs.select("key"), artifact, shards, epsilon=epsilon)


def ribbon_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return _retrieved(customers(spark, d), 1, "ribbon")


def burr_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return _retrieved(customers(spark, d), 2, "bumped")


def burr_retrieve_3(spark: SparkSession, d: str) -> DataFrame:
    return _retrieved(urls(spark, d), 3, "bumped")


# Minimal perfect hashing


def placed(hashed: DataFrame) -> DataFrame:
    """evaluate.placed() of a minimal function's values: their number is the number of keys."""
    hashed = persist(hashed, "hashed")
    return evaluate.placed(hashed, hashed.count())


def recsplit_values(spark: SparkSession, d: str) -> DataFrame:
    return placed(recsplit_of(customers(spark, d)))


def recsplit_text_values(spark: SparkSession, d: str) -> DataFrame:
    return placed(recsplit_of(texts(spark, d)))


def recsplit_verify(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.verify(recsplit_of(key_sources.distinct_keys(table(spark, d, "orders"), "o_orderkey")))


def recsplit_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The shape of each bucket's tree: its size, its nodes in preorder without a gap, and the keys in its leaves."""
    n = customers(spark, d).count()
    got = recsplit.nodes(customers(spark, d), RECSPLIT, n)
    leaf_keys = F.sum(F.when(F.col("is_leaf"), F.col("size")).otherwise(0)).alias("leaf_keys")
    return got.groupBy("bucket").agg(F.min_by("size", "preorder").alias("size"), F.max("size").alias("widest"), F.count("*").alias("nodes"), F.max("preorder").alias("last"), leaf_keys)


def recsplit_streams(spark: SparkSession, d: str) -> DataFrame:
    """Whether the streams hold what the trees' seeds take: r bits fixed, and the rest of the seed and one unary."""
    n = customers(spark, d).count()
    nodes = recsplit.nodes(customers(spark, d), RECSPLIT, n)
    r = recsplit.subtree_table(spark, 2 * RECSPLIT.bucket_size + 200, RECSPLIT.leaf).select("size", "param")
    quotient = F.call_function("shiftright", F.col("seed"), F.col("param")) + 1
    want = nodes.join(F.broadcast(r), "size").agg(F.sum("param").alias("fixed"), F.sum(quotient).alias("unary"))
    want = want.select(F.expr("stack(2, 'fixed', fixed, 'unary', unary) AS (component, wanted)"))
    return space_recsplit(spark, d).join(want, "component").select("component", (F.col("bits") == F.col("wanted")).alias("agrees"))


def built_sichash(keys: DataFrame) -> tuple[DataFrame, sichash.SicHash]:
    keys = persist(keys, "keys")
    return keys, sichash.build(keys, SICHASH, keys.count(), persist)


def sichash_perfect_verify(spark: SparkSession, d: str) -> DataFrame:
    keys, built = built_sichash(customers(spark, d))
    top = built.buckets.agg(F.sum("table_size").alias("slots"))
    got = evaluate.verify(sichash.perfect(keys, built), "slot")
    return got.crossJoin(F.broadcast(top)).select("keys", "distinct_values", "collisions", (F.col("largest") < F.col("slots")).alias("in_range"))


def sichash_minimal_values(spark: SparkSession, d: str) -> DataFrame:
    return placed(sichash.lookup(*built_sichash(customers(spark, d))))


def sichash_by_index(spark: SparkSession, d: str) -> DataFrame:
    """Whether seeds and retrieval structures give each key the slot that it was placed in."""
    keys, built = built_sichash(customers(spark, d))
    named = sichash.by_index(keys, built).withColumnRenamed("mph", "named")
    return sichash.lookup(keys, built).join(named, "key").select("key", (F.col("mph") == F.col("named")).alias("agrees"))


def sichash_holes(spark: SparkSession, d: str) -> DataFrame:
    keys, built = built_sichash(customers(spark, d))
    slots = sichash.perfect(keys, built).select("slot")
    over = slots.filter(F.col("slot") >= built.n).count()
    return sichash.holes(slots, built.n).agg((F.count("*") - over).cast("long").alias("holes_without_key"))


def shockhash_values(spark: SparkSession, d: str, plan: shockhash.Plan = SHOCKHASH) -> DataFrame:
    keys = persist(customers(spark, d), "keys")
    return placed(shockhash.lookup(keys, shockhash.build(keys, plan, keys.count(), persist)))


def bipartite_values(spark: SparkSession, d: str) -> DataFrame:
    return shockhash_values(spark, d, BIPARTITE)


def shockrecsplit_values(spark: SparkSession, d: str) -> DataFrame:
    keys = persist(customers(spark, d), "keys")
    return placed(shockrecsplit.lookup(keys, shockrecsplit.build(keys, SHOCK_RECSPLIT, keys.count(), persist)))


def grid_run(spark: SparkSession, d: str) -> DataFrame:
    """RecSplit at every point of a small grid, twice: times and rates averaged, and its space."""
    keys, runs = persist(suppliers(spark, d), "keys"), []
    n = keys.count()
    for point in evaluate.parameter_grid(spark, bucket_size=[50, 100], leaf=[5, 6]).collect():
        for seed in range(2):
            plan, made = recsplit.Plan(int(point.bucket_size), int(point.leaf), seed), {}
            took = evaluate.timed(lambda: made.setdefault("a", persist(recsplit.build(keys, plan, n), "grid")), lambda a: recsplit.lookup(keys, a, plan, n), n)
            total = evaluate.space_report(recsplit.space(made["a"]), n).first()
            runs.append((plan.bucket_size, plan.leaf, int(took["build_ms"]), int(took["lookup_ms"]), total.total_bits, took["build_keys_s"], took["lookup_keys_s"], total.bits_per_key))
    names = ["build_ms", "lookup_ms", "total_bits"], ["build_keys_s", "lookup_keys_s", "bits_per_key"]
    return evaluate.average_reports(spark.createDataFrame(runs, ["bucket_size", "leaf", *names[0], *names[1]]), ["bucket_size", "leaf"], *names)


def grid_run_sichash(spark: SparkSession, d: str) -> DataFrame:
    """SicHash at the grid's shares of classes, in buckets of 500: times, rates and space."""
    keys, runs = persist(suppliers(spark, d), "keys"), []
    n, grid = keys.count(), GRIDS["sichash"]
    for point in evaluate.parameter_grid(spark, bucket_size=grid["bucket_size"][:1], p1=grid["p1"], p2=grid["p2"], alpha=grid["alpha"]).collect():
        plan, made = sichash.Plan(int(point.bucket_size), point.p1, point.p2, point.alpha), {}
        took = evaluate.timed(lambda: made.setdefault("a", sichash.build(keys, plan, n, persist)), lambda a: sichash.lookup(keys, a), n)
        total = evaluate.space_report(sichash.space(made["a"]), n).first()
        runs.append((plan.bucket_size, plan.p1, plan.p2, int(took["build_ms"]), int(took["lookup_ms"]), total.total_bits, took["build_keys_s"], took["lookup_keys_s"], total.bits_per_key))
    names = ["build_ms", "lookup_ms", "total_bits"], ["build_keys_s", "lookup_keys_s", "bits_per_key"]
    return evaluate.average_reports(spark.createDataFrame(runs, ["bucket_size", "p1", "p2", *names[0], *names[1]]), ["bucket_size", "p1", "p2"], *names)


def dictionary_encode_join(spark: SparkSession, d: str) -> DataFrame:
    """Events per user, counted by dense id and mapped back."""
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), "value")
    ids = persist(recsplit_of(key_sources.distinct_keys(events, "key")), "user-ids")
    dense = events.join(ids, "key").groupBy("mph").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return dense.join(ids, "mph").select(F.col("key").cast("long").alias("user_id"), "n", "cents")


# Evaluation


def space_recsplit(spark: SparkSession, d: str) -> DataFrame:
    _, artifact, n = built_recsplit(customers(spark, d))
    return evaluate.space_report(recsplit.space(artifact), n)


def space_sichash(spark: SparkSession, d: str) -> DataFrame:
    _, built = built_sichash(customers(spark, d))
    return evaluate.space_report(sichash.space(built), built.n)


def space_shockhash(spark: SparkSession, d: str) -> DataFrame:
    keys = persist(customers(spark, d), "keys")
    n = keys.count()
    made = {"plain": shockhash.space(shockhash.build(keys, SHOCKHASH, n, persist)), "bipartite": shockhash.space(shockhash.build(keys, BIPARTITE, n, persist)), "trees": shockrecsplit.space(shockrecsplit.build(keys, SHOCK_RECSPLIT, n, persist))}
    parts = [evaluate.space_report(space, n).withColumn("form", F.lit(form)) for form, space in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


GRIDS = {"recsplit": {"n_keys": [1e6], "bucket_size": [500, 1000, 2000], "leaf_size": [8, 16, 24]}, "sichash": {"n_keys": [1e5], "bucket_size": [500, 1000, 2000], "p1": [0.33, 0.5], "p2": [0.33, 0.5], "alpha": [0.95]}}


def param_grid(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.parameter_grid(spark, **GRIDS["sichash"])


def param_grid_recsplit(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.parameter_grid(spark, **GRIDS["recsplit"])


def grid_average(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("build_ms"), F.col("l_linenumber").cast("double").alias("keys_s"))
    return evaluate.average_reports(runs, ["l_returnflag", "l_linestatus"], ["build_ms"], ["keys_s"])


def written_report(spark: SparkSession, d: str) -> DataFrame:
    """Report rows as they come back from the file that they are written to."""
    path = shared_path(spark, "report")
    key_sources.write_report(grid_average(spark, d).select("l_returnflag", "l_linestatus", "build_ms"), path)
    return spark.read.option("header", True).schema("l_returnflag string, l_linestatus string, build_ms long").csv(path)


# Key sets


def read_lines(spark: SparkSession, d: str) -> DataFrame:
    """Distinct lines of a folder of text files, which the query writes first, a line a part."""
    path = shared_path(spark, "lines")
    table(spark, d, "part").select("p_name").filter("p_name is not null").write.text(path)
    return key_sources.read_lines(spark, path)


def distinct_parts(spark: SparkSession, d: str) -> DataFrame:
    return key_sources.distinct_keys(table(spark, d, "part"), "p_name")


def dedupe_lines(spark: SparkSession, d: str) -> DataFrame:
    return key_sources.dedupe_lines(table(spark, d, "documents"), "text")


def sample_keys(spark: SparkSession, d: str) -> DataFrame:
    return key_sources.sample_keys(table(spark, d, "part").withColumn("key", F.col("p_partkey").cast("string")), F.col("p_size") > 10, "p_partkey", 50)


def random_keys_profile(spark: SparkSession, d: str) -> DataFrame:
    keys = key_sources.random_keys(spark, 10_000)
    return keys.agg(F.count("*").alias("keys"), F.countDistinct("key").alias("distinct_keys"), F.min(F.length("key")).alias("shortest"), F.max(F.length("key")).alias("longest"))


NAMES = """murmur32_keys murmur32_seeds murmur128_keys murmur128_swapped hash_family murmur64_keys ranges bucket_sizes table_prefix class_assign class_counts
golomb_encode golomb_decode golomb_bits golomb_params_bijection golomb_params_split fanout_table subtree_table ef_encode
ef_roundtrip ef_space golomb_wide bit_strings bit_pack bit_unpack popcount_words rank_bits select_ones rank9_counts rank9_lookup
select_inventory select_positions rank9_space ribbon_retrieve burr_retrieve burr_retrieve_3 ribbon_space burr_space recsplit_values recsplit_text_values recsplit_verify
recsplit_nodes recsplit_streams sichash_perfect_verify sichash_minimal_values sichash_holes sichash_by_index shockhash_values bipartite_values
shockrecsplit_values dictionary_encode_join space_recsplit space_sichash space_shockhash param_grid param_grid_recsplit grid_run grid_run_sichash grid_average written_report read_lines distinct_parts dedupe_lines
sample_keys random_keys_profile""".split()


def queries() -> dict:
    return {name: globals()[name] for name in NAMES}


def _grid(**values: list[float]) -> str:
    names = list(values)
    return f"SELECT {', '.join(names)} FROM " + ", ".join(f"(SELECT unnest({v}::DOUBLE[]) AS {n})" for n, v in values.items())


def oracle_sql() -> dict[str, str]:
    m32, hex64 = sql.murmur32, sql.hex64
    sized = f"g AS (SELECT size::INTEGER AS size, leaf::INTEGER AS leaf FROM range(2, 400) t(size), (SELECT unnest({list(LEAVES)}) AS leaf)), p AS (SELECT *, {sql.fanout_parts()} AS parts FROM g)"
    share = f"({m32('key', '1')} / 4294967295.0::DOUBLE)"
    bits = f"(CASE WHEN {share} < {SICHASH.p1}::DOUBLE THEN 1 WHEN {share} < {SICHASH.p1}::DOUBLE + {SICHASH.p2}::DOUBLE THEN 2 ELSE 3 END)"
    classes = f"SELECT key, ({bits} - 1)::INTEGER AS class, [2, 4, 8][{bits}]::INTEGER AS n_hash FROM ({CUSTOMERS})"
    wide = sql.murmur128_steps(CUSTOMERS, 42, 2)
    low = "CASE WHEN ceil(m / n) <= 1 THEN 0 ELSE length(bin((ceil(m / n) - 1)::BIGINT)) END::INTEGER"
    coded = f"q AS ({QUANTITIES}), c AS (SELECT id, r, CASE WHEN r > 0 THEN lpad(bin(value % (1 << r)), r, '0') ELSE '' END AS fixed, repeat('0', (value >> r)::INTEGER) || '1' AS unary FROM q)"
    ef = f"s AS ({SEQUENCES}), a AS (SELECT g, count(*) AS n, max(value) AS m FROM s GROUP BY g), l AS (SELECT *, {low} AS l FROM a), e AS (SELECT g, value, n, m, l, value >> l AS high, value & ((1 << l) - 1) AS low, row_number() OVER (PARTITION BY g ORDER BY value) - 1 AS i FROM s JOIN l USING (g)), d AS (SELECT *, high - coalesce(lag(high) OVER (PARTITION BY g ORDER BY value), 0) AS gap FROM e)"
    dense = lambda keys: f"SELECT key, true AS in_range, true AS alone FROM ({keys})"
    grown = f"t AS (SELECT root, size, row_number() OVER () AS id FROM trees WHERE size >= 2), g AS (SELECT root, size::INTEGER AS size, {RECSPLIT.leaf} AS leaf FROM t)"
    shape = f"trees(root, size) AS (SELECT s, s FROM roots UNION ALL SELECT root, unnest({sql.fanout_parts('size', str(RECSPLIT.leaf))}) FROM trees WHERE size > {RECSPLIT.leaf}), {grown}"
    best = f"CASE WHEN size > leaf THEN {sql.golomb_parameter('1 / sqrt(pow(2 * pi(), len(parts) - 1) * list_reduce(list_transform(parts, lambda x: x::DOUBLE), lambda x, y: x * y) / size)')} ELSE {sql.golomb_parameter('sqrt(2 * pi() * size) / exp(size)')} END"
    verify = lambda keys: f"SELECT count(*) AS keys, count(*) AS distinct_values, 0::BIGINT AS collisions, 0::BIGINT AS least, count(*) - 1 AS largest FROM ({keys})"
    every = f"e AS (SELECT greatest(ceil(8 * sum(bit) / count(*)), 1)::BIGINT AS every FROM b)"
    return {
        "murmur32_keys": f"SELECT key, {m32('key')} AS m32 FROM ({URLS} UNION ALL {CUSTOMERS})",
        "murmur32_seeds": f"SELECT key, {', '.join(f'{m32("key", str(s))} AS m32_{s}' for s in (1, 7, 42))} FROM ({SUPPLIERS})",
        "murmur128_keys": f"WITH {sql.murmur128_steps(URLS, 42, 4)} SELECT key, {hex64('h1')} AS h1, {hex64('h2')} AS h2 FROM m",
        "murmur128_swapped": f"WITH {sql.murmur128_steps(URLS, 42, 4)} SELECT key, {hex64('h2')} AS h1, {hex64('h1')} AS h2 FROM m",
        "hash_family": " UNION ALL ".join(f"SELECT key, {i}::INTEGER AS i, {m32('key', str(5 + i))} AS h FROM ({SUPPLIERS})" for i in range(4)),
        "murmur64_keys": f"WITH {wide}, z1 AS (SELECT key, h1, h2, (xor(h1, h1 // 8589934592::UHUGEINT) * {0xFF51AFD7ED558CCD}::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM m), z2 AS (SELECT key, h1, h2, (xor(x, x // 8589934592::UHUGEINT) * {0xC4CEB9FE1A85EC53}::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM z1) SELECT key, {hex64("((h2 * (xor(x, x // 8589934592::UHUGEINT) % 4 + 1)::UHUGEINT) % 18446744073709551616::UHUGEINT + h1) % 18446744073709551616::UHUGEINT")} AS m64 FROM z2",
        "ranges": f"WITH {wide} SELECT key, (({m32('key')} >> 16) * 31) >> 16 AS fast16, {m32('key')} % 97 AS mod97, ((h2 * 1000::UHUGEINT) // 18446744073709551616::UHUGEINT)::BIGINT AS fast64, (h1 % 101::UHUGEINT)::BIGINT AS mod101, (((h2 % 103::UHUGEINT) * (18446744073709551616::UHUGEINT % 103::UHUGEINT) + h1 % 103::UHUGEINT) % 103::UHUGEINT)::BIGINT AS wide103 FROM m",
        "bucket_sizes": f"WITH {wide}, c AS (SELECT ((h2 * 16::UHUGEINT) // 18446744073709551616::UHUGEINT)::BIGINT AS bucket, count(*) AS size FROM m GROUP BY 1) SELECT bucket, size, coalesce(sum(size) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS size_before FROM c",
        "table_prefix": f"WITH c AS (SELECT (({m32('key', '42')} >> 16) * 8) >> 16 AS bucket, count(*) AS size FROM ({CUSTOMERS}) GROUP BY 1), t AS (SELECT *, floor(size / {SICHASH.alpha}::DOUBLE)::BIGINT AS table_size FROM c) SELECT *, coalesce(sum(table_size) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS table_size_before FROM t",
        "class_assign": classes,
        "class_counts": f"SELECT class, count(*) AS n FROM ({classes}) GROUP BY class",
        "golomb_encode": f"WITH {coded} SELECT id, fixed, unary FROM c",
        "golomb_decode": f"SELECT id, value FROM ({QUANTITIES})",
        "golomb_bits": f"SELECT r, sum(r + (value >> r) + 1)::BIGINT AS bits FROM ({QUANTITIES}) GROUP BY r",
        "golomb_params_bijection": f"SELECT m::INTEGER AS m, {sql.golomb_parameter('sqrt(2 * pi() * m) / exp(m)')} AS param FROM range(1, 25) t(m)",
        "golomb_params_split": f"WITH {sized} SELECT size, leaf, {sql.golomb_parameter('1 / sqrt(pow(2 * pi(), len(parts) - 1) * list_reduce(list_transform(parts, lambda x: x::DOUBLE), lambda x, y: x * y) / size)')} AS param FROM p WHERE size > leaf",
        "fanout_table": f"WITH {sized} SELECT size, leaf, array_to_string(parts, ',') AS parts FROM p",
        "subtree_table": f"WITH RECURSIVE roots AS (SELECT range::INTEGER AS s FROM range(1, 401)), {shape}, p AS (SELECT *, {sql.fanout_parts()} AS parts FROM g), b AS (SELECT root, size, {best} AS param FROM p), a AS (SELECT root, count(*) AS nodes, sum(param) AS bits FROM b GROUP BY root), o AS (SELECT DISTINCT size, param FROM b WHERE size = root) SELECT s AS size, coalesce(param, 0)::INTEGER AS param, coalesce(nodes, 0)::INTEGER AS nodes, coalesce(bits, 0)::INTEGER AS fixed_bits FROM roots LEFT JOIN a ON a.root = s LEFT JOIN o ON o.size = s",
        "ef_encode": f"WITH {ef} SELECT g, string_agg(repeat('0', gap::INTEGER) || '1', '' ORDER BY value) AS upper, string_agg(CASE WHEN l > 0 THEN lpad(bin(low), l, '0') ELSE '' END, '' ORDER BY value) AS lower, any_value(m) AS m, any_value(n) AS n, any_value(l) AS l FROM d GROUP BY g",
        "ef_roundtrip": f"SELECT g, (row_number() OVER (PARTITION BY g ORDER BY value) - 1)::INTEGER AS i, value FROM ({SEQUENCES})",
        "ef_space": f"WITH {ef} SELECT g, n * l + n + (m >> l) AS bits FROM l",
        "bit_strings": "SELECT o_orderkey AS id, reverse(bin(o_orderkey)) AS bits, o_orderkey AS back, (CASE WHEN o_orderkey > 0 THEN length(bin(o_orderkey)) - 1 ELSE -1 END)::INTEGER AS highest, (CASE WHEN o_orderkey > 0 THEN floor(log2(1.5 * o_orderkey)) ELSE -1 END)::INTEGER AS nearest FROM orders",
        "golomb_wide": f"SELECT o_orderkey AS id, xor({(1 << 62) - 1}::BIGINT, o_custkey * 524287) AS value FROM orders",
        "bit_pack": f"WITH {WORDS} SELECT word_no, {hex64('word')} AS word FROM w",
        "bit_unpack": f"WITH b AS ({EVENT_BITS}), t AS (SELECT range AS pos FROM range((SELECT (max(pos) // 64 + 1) * 64 FROM b))) SELECT coalesce(bit, 0)::INTEGER AS bit, count(*) AS n, sum(t.pos)::BIGINT AS positions FROM t LEFT JOIN b USING (pos) GROUP BY 1",
        "popcount_words": f"SELECT pos // 64 AS word_no, sum(bit)::INTEGER AS ones FROM ({EVENT_BITS}) GROUP BY 1",
        "rank_bits": f"SELECT pos, (sum(bit) OVER (ORDER BY pos) - bit)::BIGINT AS rank, (sum(bit) OVER (ORDER BY pos))::BIGINT AS rank_inclusive FROM ({EVENT_BITS})",
        "select_ones": f"SELECT row_number() OVER (ORDER BY pos) AS r, pos FROM ({EVENT_BITS}) WHERE bit = 1",
        "rank9_counts": f"WITH b AS ({EVENT_BITS}), o AS (SELECT pos // 512 AS block, (pos // 64) % 8 AS k, sum(bit)::BIGINT AS ones FROM b GROUP BY 1, 2), i AS (SELECT *, coalesce(sum(ones) OVER (PARTITION BY block ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pre FROM o), s AS (SELECT block, sum(ones)::BIGINT AS total, sum(CASE WHEN k > 0 THEN pre << (9 * (k - 1)) ELSE 0 END)::BIGINT AS inside FROM i GROUP BY block) SELECT block, coalesce(sum(total) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, {hex64('inside')} AS inside FROM s",
        "rank9_lookup": f"SELECT pos, (sum(bit) OVER (ORDER BY pos) - bit)::BIGINT AS rank FROM ({EVENT_BITS})",
        "select_inventory": f"WITH b AS ({EVENT_BITS}), {every}, r AS (SELECT pos, (sum(bit) OVER (ORDER BY pos))::BIGINT AS ranked FROM b), s AS (SELECT pos, ranked, pos // (every * 16) AS part, pos % (every * 16) = 0 AS head FROM r, e WHERE pos % every = 0) SELECT s.pos, h.ranked AS primary_rank, s.ranked - h.ranked AS secondary_rank FROM s JOIN s h ON h.part = s.part AND h.head",
        "select_positions": f"WITH o AS (SELECT row_number() OVER (ORDER BY pos) AS r, pos FROM ({EVENT_BITS}) WHERE bit = 1), q AS (SELECT range AS r FROM range(0, (SELECT count(*) FROM events) + 3, 3)) SELECT q.r, CASE WHEN q.r = 0 THEN 0 ELSE o.pos END AS pos FROM q LEFT JOIN o ON o.r = q.r",
        "rank9_space": f"WITH b AS ({EVENT_BITS}), c AS (SELECT count(DISTINCT pos // 64) AS words, count(DISTINCT pos // 512) AS blocks FROM b) SELECT words, blocks, 64 * (words + 2 * blocks) AS bits FROM c",
        "ribbon_retrieve": f"SELECT key, ({m32('key')} % 2)::INTEGER AS value FROM ({CUSTOMERS})",
        "burr_retrieve": f"SELECT key, ({m32('key')} % 4)::INTEGER AS value FROM ({CUSTOMERS})",
        "burr_retrieve_3": f"SELECT key, ({m32('key')} % 8)::INTEGER AS value FROM ({URLS})",
        "recsplit_values": dense(CUSTOMERS),
        "recsplit_text_values": dense("SELECT DISTINCT text AS key FROM documents WHERE text IS NOT NULL"),
        "recsplit_verify": verify("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL"),
        "recsplit_nodes": f"WITH RECURSIVE {wide}, n AS (SELECT greatest(1, (count(*) + 99) // 100) AS buckets FROM m), c AS (SELECT ((h2 * buckets::UHUGEINT) // 18446744073709551616::UHUGEINT)::BIGINT AS bucket, count(*)::INTEGER AS size FROM m, n GROUP BY buckets, 1), roots AS (SELECT DISTINCT size AS s FROM c), {shape}, a AS (SELECT root, count(*) AS nodes, sum(CASE WHEN size <= {RECSPLIT.leaf} THEN size ELSE 0 END)::BIGINT AS leaf_keys FROM g GROUP BY root) SELECT bucket, size, size AS widest, nodes, (nodes - 1)::INTEGER AS last, leaf_keys FROM c JOIN a ON a.root = size",
        "recsplit_streams": "SELECT unnest(['fixed', 'unary']) AS component, true AS agrees",
        "sichash_perfect_verify": f"SELECT count(*) AS keys, count(*) AS distinct_values, 0::BIGINT AS collisions, true AS in_range FROM ({CUSTOMERS})",
        "sichash_minimal_values": dense(CUSTOMERS),
        "sichash_by_index": f"SELECT key, true AS agrees FROM ({CUSTOMERS})",
        "sichash_holes": "SELECT 0::BIGINT AS holes_without_key",
        "shockhash_values": dense(CUSTOMERS),
        "bipartite_values": dense(CUSTOMERS),
        "shockrecsplit_values": dense(CUSTOMERS),
        "dictionary_encode_join": "SELECT user_id, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY user_id",
        "param_grid": _grid(**GRIDS["sichash"]),
        "param_grid_recsplit": _grid(**GRIDS["recsplit"]),
        "grid_average": "SELECT l_returnflag, l_linestatus, floor(avg(l_quantity::BIGINT))::BIGINT AS build_ms, avg(l_linenumber::DOUBLE) AS keys_s FROM lineitem GROUP BY ALL",
        "written_report": "SELECT l_returnflag, l_linestatus, floor(avg(l_quantity::BIGINT))::BIGINT AS build_ms FROM lineitem GROUP BY ALL",
        "read_lines": "SELECT DISTINCT p_name AS key FROM part WHERE p_name IS NOT NULL",
        "distinct_parts": "SELECT DISTINCT p_name AS key FROM part WHERE p_name IS NOT NULL",
        "dedupe_lines": "SELECT DISTINCT trim(line) AS line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)",
        "sample_keys": "SELECT p_partkey::VARCHAR AS key FROM part WHERE p_size > 10 ORDER BY md5('42:' || p_partkey::VARCHAR), key LIMIT 50",
        "random_keys_profile": "SELECT 10000::BIGINT AS keys, 10000::BIGINT AS distinct_keys, 10::INTEGER AS shortest, 10::INTEGER AS longest",
    }
