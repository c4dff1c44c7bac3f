"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

import json
import os
import time

DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
QUERIES = """murmur32_keys golomb_encode rank_bits select_ones ef_roundtrip burr_retrieve recsplit_verify sichash_minimal_values
shockhash_values dictionary_encode_join""".split()


def main() -> None:
    from pyspark.sql import SparkSession

    from keyloom.operators import evaluate, recsplit, sichash
    from keyloom.plans import catalogue
    from keyloom.plans.persist import persist

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(10).selectExpr("sum(id)").collect()
    took = {}
    for name in QUERIES:
        begun = time.perf_counter()
        catalogue.queries()[name](spark, DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begun, 3)
    orders = persist(catalogue.key_sources.distinct_keys(catalogue.table(spark, DIR, "orders"), "o_orderkey"), "bench-orders")
    names = persist(catalogue.customers(spark, DIR), "bench-customers")

    def measured(keys, build, look_up, space) -> dict:
        n, made = keys.count(), []
        report = evaluate.timed(lambda: made.append(build(keys, n)) or made[0], lambda a: look_up(keys, a, n), n)
        bits = evaluate.space_report(space(made[0]), n).first().bits_per_key
        return {"keys": n, **{k: round(v, 1) for k, v in report.items()}, "bits_per_key": round(bits, 3)}

    def recsplit_at(keys, plan) -> dict:
        return measured(keys, lambda k, n: persist(recsplit.build(k, plan, n), "bench"), lambda k, a, n: recsplit.lookup(k, a, plan, n), recsplit.space)

    def sichash_at(keys, plan) -> dict:
        return measured(keys, lambda k, n: sichash.build(k, plan, n, persist), lambda k, a, n: sichash.lookup(k, a), sichash.space)

    detail = {
        "recsplit_100_8": recsplit_at(orders, catalogue.RECSPLIT),
        "recsplit_500_12": recsplit_at(names, recsplit.Plan(bucket_size=500, leaf=12)),
        "sichash_5000": sichash_at(names, sichash.Plan(bucket_size=5000, p1=0.49, p2=0.22, alpha=0.9768)),
    }
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(DIR.rstrip("/")), "functions": detail}))


if __name__ == "__main__":
    main()
