"""Queries of sources, projections, contracts and joins."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import align as A
from ..operators import contracts as C
from ..operators import splits as SP
from ..operators.summary import last_eras
from ..sources import layout as L
from ..sources import panel as P
from ..sources.store import shared_folder as scratch
from .cohorts import EVENTS, LINEITEM, ORDERS, events, lineitem, orders, pct_sql, query, r, rs

# sources -------------------------------------------------------------------------------------------------------------


@query("src1_projected_scan", f"SELECT l_orderkey, {rs('l_quantity')} AS l_quantity FROM lineitem")
def projected(spark, sf_dir):
    return P.read_columns(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"]).select("l_orderkey", r("l_quantity").alias("l_quantity"))


@query("src2_era_scan", f"WITH {ORDERS} SELECT id, era FROM orders_c WHERE era IN ('0003', '0017', '0041')")
def era_scan(spark, sf_dir):
    return P.in_eras(orders(spark, sf_dir, [(3, 3), (17, 17), (41, 41)]), ["0003", "0017", "0041"]).select("id", "era")


@query("src2_era_semi_join", f"WITH {ORDERS} SELECT id, era FROM orders_c WHERE era IN (SELECT era FROM orders_c GROUP BY era HAVING count(*) > 150)")
def era_semi(spark, sf_dir):
    df = orders(spark, sf_dir)
    return P.in_eras(df, df.groupBy("era").count().filter("count > 150")).select("id", "era")


_DAILY = "d AS (SELECT era, ticker, avg(prediction) AS signal, avg(benchmark) AS n1, count(*) AS weight FROM events_c GROUP BY ALL)"


@query("src3_neutralizers_by_date", f"WITH {EVENTS}, {_DAILY} SELECT e.id, e.era, {rs('n1')} AS n1 FROM events_c e JOIN d ON e.era = d.era AND e.ticker = d.ticker WHERE e.era >= '20240105'")
def by_date(spark, sf_dir):
    """A matrix of all days in a folder each; the days of the rows prune its scan."""
    e = events(spark, sf_dir)
    matrix = L.write_matrix(e.groupBy("era", "ticker").agg(F.avg("benchmark").alias("n1")), scratch(spark, "matrix"), "era")
    return L.join_by_date(events(spark, sf_dir, "2024-01-05"), matrix, ["era", "ticker"], "era").select("id", "era", r("n1").alias("n1"))


@query("src4_feature_sets", "WITH s AS (SELECT DISTINCT p_brand AS feature_set, p_type AS feature FROM part) SELECT a.feature_set AS a, b.feature_set AS b, count(*) AS size FROM s a JOIN s b ON a.feature = b.feature GROUP BY ALL")
def feature_sets(spark, sf_dir):
    """A metadata file of feature sets, here brands and their types, is written, read and crossed."""
    sets = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("l"))  # a set has as many members as there are types
    one = sets.agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "l"))).alias("feature_sets"))
    path = scratch(spark, "feature-sets")
    one.coalesce(1).select(F.to_json(F.struct("feature_sets")).alias("value")).write.text(path)
    return P.set_overlaps(P.feature_sets(spark, path))


@query(
    "src5_results",
    f"WITH {LINEITEM}, m AS (SELECT era, avg(prediction) AS m, stddev_pop(prediction) AS s, CASE WHEN CAST(era AS BIGINT) % 2 = 0 THEN avg(benchmark) END AS late, avg(feature_b) AS bmc FROM lineitem_c GROUP BY era) SELECT era AS model, {rs('m', 4)} AS corr_mean, {rs('m / nullif(s, 0)', 6)} AS corr_sharpe, {rs('coalesce(late, bmc)', 6)} AS bmc_mean FROM m",
)
def results(spark, sf_dir):
    """Results records with and without the recent section, written as JSON and read back."""
    per = lineitem(spark, sf_dir).groupBy("era").agg(F.avg("prediction").alias("m"), F.stddev_pop("prediction").alias("s"), F.avg("benchmark").alias("late"), F.avg("feature_b").alias("b"))
    corr = F.struct(F.col("m").alias("mean"), F.col("s").alias("std"), (F.col("m") / F.col("s")).alias("sharpe"))
    late = F.when(F.col("era").cast("bigint") % 2 == 0, F.struct(F.col("late").alias("mean")))
    path = scratch(spark, "results")
    per.select(F.col("era").alias("model"), F.struct(corr.alias("corr"), F.struct(F.col("b").alias("mean")).alias("bmc"), late.alias("bmc_last_200_eras")).alias("metrics")).write.json(path)
    return P.results(spark, path).select("model", r("corr_mean", 4).alias("corr_mean"), r("corr_sharpe", 6).alias("corr_sharpe"), r("bmc_mean", 6).alias("bmc_mean"))


@query("src6_multi_source_load", f"WITH {ORDERS}, {LINEITEM} SELECT id, era, {rs('feature_a')} AS feature_a, NULL::DOUBLE AS extra FROM orders_c UNION ALL SELECT id, era, {rs('feature_a')}, {rs('feature_b')} FROM lineitem_c")
def multi(spark, sf_dir):
    a = orders(spark, sf_dir).select("id", "era", r("feature_a").alias("feature_a"))
    return a.unionByName(lineitem(spark, sf_dir).select("id", "era", r("feature_a").alias("feature_a"), r("feature_b").alias("extra")), allowMissingColumns=True)


_TRAINING = "CAST(era AS BIGINT) <= 50"


@query("src6_panel_files", f"WITH {ORDERS} SELECT id, era, CASE WHEN NOT ({_TRAINING}) THEN {rs('benchmark')} END AS benchmark FROM orders_c")
def panel_files(spark, sf_dir):
    """A panel written as train and validation files, of which only the latter have the benchmark, loaded as one."""
    df, root = orders(spark, sf_dir), scratch(spark, "panel")
    df.filter(_TRAINING).select("id", "era").write.parquet(f"{root}/train")
    df.filter(f"not ({_TRAINING})").select("id", "era", r("benchmark").alias("benchmark")).write.parquet(f"{root}/validation")
    return P.load_panel(spark, f"{root}/full", f"{root}/train", f"{root}/validation", ["id", "era", "benchmark"])


@query("src7_resolved_columns", f"WITH {ORDERS} SELECT id, {rs('feature_a')} AS by_suffix, {rs('benchmark')} AS by_part FROM orders_c")
def resolved(spark, sf_dir):
    df = orders(spark, sf_dir)
    return df.select("id", r(P.resolve_column(df, "ure_a")).alias("by_suffix"), r(P.resolve_column(df, "bench")).alias("by_part"))


_TYPED = "t AS (SELECT *, CASE WHEN CAST(era AS BIGINT) <= 50 THEN 'train' WHEN CAST(era AS BIGINT) <= 76 THEN 'validation' ELSE 'live' END AS data_type FROM orders_c)"


def _typed(spark, sf_dir):
    e = F.col("era").cast("bigint")
    df = orders(spark, sf_dir).withColumn("data_type", F.when(e <= 50, "train").when(e <= 76, "validation").otherwise("live"))
    return df.filter("data_type = 'train'"), df.filter("data_type <> 'train'")


@query("src8_full_panel", f"WITH {ORDERS}, {_TYPED} SELECT id, era FROM t WHERE data_type <> 'live'")
def full_panel(spark, sf_dir):
    train, rest = _typed(spark, sf_dir)
    return P.full_panel(train, rest).select("id", "era")


@query("src9_full_benchmark", f"WITH {ORDERS}, {_TYPED} SELECT id, {rs('benchmark')} AS benchmark FROM t WHERE data_type <> 'live'")
def full_benchmark(spark, sf_dir):
    train, rest = _typed(spark, sf_dir)
    return P.full_benchmark(train.select("id", "benchmark"), rest.select("id", "benchmark"), rest).select("id", r("benchmark").alias("benchmark"))


_KEPT = "kept AS (SELECT era FROM (SELECT era, row_number() OVER (ORDER BY era) - 1 AS i FROM (SELECT DISTINCT era FROM orders_c)) WHERE i % 4 = 1)"


@query("src10_every_fourth_era", f"WITH {ORDERS}, {_KEPT} SELECT id, era FROM orders_c WHERE era IN (SELECT era FROM kept)")
def downsampled(spark, sf_dir):
    return SP.every_nth_era(orders(spark, sf_dir), 4, 1).select("id", "era")


@query("src11_surviving_benchmark", f"WITH {ORDERS}, {_KEPT} SELECT id, {rs('benchmark')} AS benchmark FROM orders_c WHERE id IN (SELECT id FROM orders_c WHERE era IN (SELECT era FROM kept))")
def surviving(spark, sf_dir):
    df = orders(spark, sf_dir)
    return P.surviving(df.select("id", "benchmark"), SP.every_nth_era(df, 4, 1)).select("id", r("benchmark").alias("benchmark"))


@query("src12_filtered_rewrite", f"WITH {ORDERS} SELECT id, era, {rs('target')} AS target FROM orders_c WHERE target > 5e-1")
def rewrite(spark, sf_dir):
    return P.write_filtered(orders(spark, sf_dir).filter("target > 0.5").select("id", "era", r("target").alias("target")), scratch(spark, "rewrite"))


@query("src13_feature_store", f"WITH {ORDERS} SELECT id, era, {rs('feature_a')} AS feature_a, {rs('benchmark')} AS benchmark, row_number() OVER (ORDER BY era, id) - 1 AS row_offset FROM orders_c WHERE feature_b <> 0")
def feature_store(spark, sf_dir):
    df = orders(spark, sf_dir)
    out = P.feature_store(df.drop("benchmark"), df.filter("feature_b <> 0").select("id", "era", "benchmark"), ["feature_a", "feature_b"], "target", "benchmark")
    return out.select("id", "era", r("feature_a").alias("feature_a"), r("benchmark").alias("benchmark"), "row_offset")


@query("src13_era_buckets", f"WITH {ORDERS} SELECT id, era, {rs('benchmark')} AS benchmark FROM orders_c WHERE era IN ('0003', '0030', '0031', '0077') OR CAST(era AS BIGINT) <= 2")
def era_buckets(spark, sf_dir):
    """A store by buckets of 12 eras, read for some eras and up to one."""
    path = scratch(spark, "buckets")
    L.write_era_buckets(orders(spark, sf_dir).select("id", "era", "benchmark"), path, width=12)
    some = L.read_era_buckets(spark, path, ["0003", "0030", "0031", "0077", "9999"])
    return some.unionByName(L.read_era_buckets(spark, path, last=2)).select("id", "era", r("benchmark").alias("benchmark"))


@query("src14_prefix_extract", f"WITH {ORDERS} SELECT id, era FROM orders_c WHERE CAST(era AS BIGINT) <= 30")
def prefix(spark, sf_dir):
    """A table clustered by era, whose row groups beyond the era are skipped."""
    stored = L.write_by_era(orders(spark, sf_dir).select("id", "era", "prediction"), scratch(spark, "by-era"))
    return P.up_to_era(stored, 30, width=4).select("id", "era")


@query("src15_digest", f"WITH {ORDERS} SELECT era, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5('=' || id || chr(31) || '=' || CAST(CAST(target * 4 AS BIGINT) AS VARCHAR)), 1, 8) AS BIGINT)) AS BIGINT) AS content FROM orders_c GROUP BY era")
def digest(spark, sf_dir):
    return P.digest(orders(spark, sf_dir).withColumn("q", (F.col("target") * 4).cast("bigint")), ["id", "q"], ["era"])


@query(
    "src15_fingerprint",
    f"""WITH {ORDERS}, e AS (SELECT sha256(string_agg(era, ',' ORDER BY era)) AS eras_sha256 FROM (SELECT DISTINCT era FROM orders_c))
    SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5('=' || id || chr(31) || '=' || CAST(CAST(target * 4 AS BIGINT) AS VARCHAR)), 1, 8) AS BIGINT)) AS BIGINT) AS content, max(eras_sha256) AS eras_sha256,
    sha256('[["id","string"],["era","string"],["feature_a","double"],["feature_b","double"],["q","bigint"]]') AS schema_sha256, sha256('["feature_a","feature_b"]') AS features_sha256 FROM orders_c, e""",
)
def fingerprint(spark, sf_dir):
    df = orders(spark, sf_dir).select("id", "era", "feature_a", "feature_b", (F.col("target") * 4).cast("bigint").alias("q"))
    return P.fingerprint(df, ["feature_a", "feature_b"], ["id", "q"])


@query("src16_oof_sink", f"WITH {ORDERS} SELECT id, era, {rs('target')} AS target, {rs('prediction')} AS prediction, CAST(CAST(era AS BIGINT) % 5 AS INTEGER) AS cv_fold FROM orders_c")
def oof_sink(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("cv_fold", (F.col("era").cast("bigint") % 5).cast("int"))
    out = P.write_predictions(df, scratch(spark, "oof"), "target", {"scale": "raw"})
    assert json.loads(out.schema["prediction"].metadata["semantics"]) == {"scale": "raw"}
    return out.select("id", "era", r("target").alias("target"), r("prediction").alias("prediction"), "cv_fold")


@query("src17_long_csv_sink", f"WITH {ORDERS}, m AS (SELECT era, round(avg(prediction), 4) AS a, round(avg(benchmark), 4) AS b FROM orders_c GROUP BY era) SELECT era, 'a' AS metric, {rs('a', 4)} AS value FROM m UNION ALL SELECT era, 'b', {rs('b', 4)} FROM m")
def csv_sink(spark, sf_dir):
    per = orders(spark, sf_dir).groupBy("era").agg(F.round(F.avg("prediction"), 4).alias("a"), F.round(F.avg("benchmark"), 4).alias("b"))
    return P.write_long_scores(per, scratch(spark, "scores"), ["era"], ["a", "b"]).select("era", "metric", r("value", 4).alias("value"))


@query("src18_submission_sink", f"WITH {ORDERS}, k AS (SELECT id, (rank() OVER (PARTITION BY era ORDER BY prediction) + (count(*) OVER (PARTITION BY era, prediction) - 1) / 2e0 - 5e-1) / count(*) OVER (PARTITION BY era) AS s FROM orders_c WHERE era = '0040') SELECT id, {rs('s', 6)} AS signal FROM k")
def submission(spark, sf_dir):
    from ..operators.ranks import transform_in_groups

    ranked = transform_in_groups(orders(spark, sf_dir).filter("era = '0040'"), {"signal": ("tie_kept", "prediction")}, ["era"]).select("id", "signal")
    path = scratch(spark, "submission")
    ranked.write.option("header", True).csv(path)
    return P.df_csv(spark, path, ranked.schema).select("id", r("signal", 6).alias("signal"))


@query("src19_positional_split", f"WITH {ORDERS} SELECT id, CASE WHEN row_number() OVER (ORDER BY era, id) <= floor(count(*) OVER () * 7e-1) THEN 'train' ELSE 'validation' END AS part FROM orders_c")
def positional(spark, sf_dir):
    return SP.positional_split(orders(spark, sf_dir), 0.7).select("id", "part")


@query("src20_live_drops", f"WITH {EVENTS} SELECT id, era, {rs(pct_sql('prediction'))} AS prediction FROM events_c")
def live_drops(spark, sf_dir):
    """Every day in two files that hold parts of it; a file stream ranks each day that a drop touches again as a whole, and a
    second call finds nothing new."""
    from ..operators.ranks import transform_in_groups
    from ..streaming.live import rank_drops

    df = events(spark, sf_dir).select("id", "era", "prediction")
    drops, out, checkpoint = (scratch(spark, n) for n in ("drops", "ranked", "stream"))
    half = F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(2))
    for h in range(2):
        df.filter(half == h).repartitionByRange(4, "era").write.mode("append").parquet(drops)
    rank = lambda b: transform_in_groups(b, {"v": ("percent", "prediction")}, ["era"]).select("id", "era", r("v").alias("prediction"))
    for _ in range(2):
        rank_drops(spark, drops, df.schema, lambda b: b, rank, out, checkpoint)
    return spark.read.schema("id string, prediction double, era string").parquet(f"{out}/ranked").select("id", "era", "prediction")


# projections and contracts -------------------------------------------------------------------------------------------


@query("prj1_groups", f"WITH {ORDERS} SELECT {rs('feature_a')} AS feature_a, {rs('feature_b')} AS feature_b, era, id FROM orders_c")
def groups(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("feature_a", r("feature_a")).withColumn("feature_b", r("feature_b"))
    return P.select_groups(df, ["features", "era", "some", "id"], {"features": ["feature_a", "feature_b"], "era": ["era"], "some": ["feature_b"], "id": ["id"]})


_KEYS = "k AS (SELECT CASE WHEN feature_b = 1 THEN NULL ELSE CAST(CAST(id AS BIGINT) // 3 AS VARCHAR) END AS id, CASE WHEN feature_a = 2 THEN NULL ELSE era END AS era FROM orders_c)"


@query("prj2_key_contract", f"WITH {ORDERS}, {_KEYS} SELECT count(*) FILTER (id IS NULL) AS null_keys, count(id) - count(DISTINCT id) AS duplicate_rows, count(*) FILTER (era IS NULL) AS null_eras, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS empty FROM k")
def key_contract(spark, sf_dir):
    df = orders(spark, sf_dir).select(F.when(F.col("feature_b") != 1, F.floor(F.col("id").cast("bigint") / 3).cast("string")).alias("id"), F.when(F.col("feature_a") != 2, F.col("era")).alias("era"))
    return C.key_contract(df)


@query("prj3_finite_contract", f"WITH {ORDERS} SELECT count(*) FILTER (feature_b IN (1, 2)) AS a, count(*) FILTER (feature_a = 3) AS b FROM orders_c")
def finite_contract(spark, sf_dir):
    df = orders(spark, sf_dir)
    a = F.when(F.col("feature_b") == 1, float("nan")).when(F.col("feature_b") == 2, float("inf")).otherwise(F.col("prediction"))
    return C.finite_contract(df.select(a.alias("a"), F.when(F.col("feature_a") != 3, F.col("target")).alias("b")), ["a", "b"])


@query(
    "prj4_era_contract",
    f"WITH {ORDERS}, e AS (SELECT DISTINCT CASE WHEN era = '0005' THEN 'x5' WHEN era = '0006' THEN '6' ELSE era END AS era FROM orders_c WHERE era <> '0031'), g AS (SELECT *, TRY_CAST(era AS BIGINT) - lag(TRY_CAST(era AS BIGINT)) OVER (ORDER BY TRY_CAST(era AS BIGINT) NULLS FIRST) > 1 AS gap FROM e) SELECT count(*) FILTER (NOT regexp_full_match(era, '[0-9]+')) AS not_digits, count(DISTINCT length(era)) - 1 AS extra_widths, count(*) FILTER (gap) AS gaps FROM g",
)
def era_contract(spark, sf_dir):
    df = orders(spark, sf_dir).filter("era <> '0031'")
    return C.era_contract(df.select(F.when(F.col("era") == "0005", "x5").when(F.col("era") == "0006", "6").otherwise(F.col("era")).alias("era")))


@query("prj5_allowlist", f"WITH {ORDERS}, a AS (SELECT DISTINCT CASE WHEN era = '0010' THEN '9999' ELSE era END AS era FROM orders_c), s AS (SELECT DISTINCT era FROM orders_c) SELECT era, 'missing' AS problem FROM a WHERE era NOT IN (SELECT era FROM s) UNION ALL SELECT era, 'unexpected' FROM s WHERE era NOT IN (SELECT era FROM a)")
def allowlist(spark, sf_dir):
    df = orders(spark, sf_dir)
    return C.allowlist(df, df.select(F.when(F.col("era") == "0010", "9999").otherwise(F.col("era")).alias("era")))[1]


@query("prj6_forbidden_eras", f"WITH {ORDERS} SELECT count(*) FILTER (CAST(era AS BIGINT) >= 70) AS forbidden_rows FROM orders_c")
def forbidden(spark, sf_dir):
    return C.forbidden_eras(orders(spark, sf_dir), 70)


@query("prj7_missing_when_all", f"WITH {ORDERS}, x AS (SELECT id, era, CASE WHEN CAST(era AS BIGINT) % 9 = 0 THEN 2e0 ELSE feature_b END AS f FROM orders_c) SELECT id, era, CASE WHEN bool_and(f = 2) OVER (PARTITION BY era) THEN NULL ELSE f END AS f FROM x")
def missing(spark, sf_dir):
    df = orders(spark, sf_dir).select("id", "era", F.when(F.col("era").cast("bigint") % 9 == 0, 2.0).otherwise(F.col("feature_b")).alias("f"))
    return P.missing_when_all(df, ["f"]).select("id", "era", "f")


@query("prj8_dropna", f"WITH {ORDERS} SELECT id FROM orders_c WHERE feature_b <> 1 AND feature_a <> 2")
def dropna(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("x", F.when(F.col("feature_b") == 1, float("nan")).otherwise(F.col("prediction"))).withColumn("y", F.when(F.col("feature_a") != 2, F.col("target")))
    return P.present(df, ["x", "y"]).select("id")


@query("prj9_start_era", f"WITH {ORDERS}, x AS (SELECT id, CASE WHEN era = '0003' THEN 'none' ELSE 'era' || era END AS era FROM orders_c) SELECT id, era FROM x WHERE TRY_CAST(nullif(regexp_replace(era, '[^0-9]', '', 'g'), '') AS BIGINT) IS NULL OR TRY_CAST(nullif(regexp_replace(era, '[^0-9]', '', 'g'), '') AS BIGINT) >= 30")
def start_era(spark, sf_dir):
    """Digits of the era from a start on; eras without digits stay."""
    x = orders(spark, sf_dir).select("id", F.when(F.col("era") == "0003", "none").otherwise(F.concat(F.lit("era"), "era")).alias("era"))
    return P.from_era(x, 30)


@query("prj10_post_train_embargo", f"WITH {ORDERS}, {_TYPED} SELECT id, era FROM t WHERE data_type = 'validation' AND CAST(era AS BIGINT) > (SELECT max(CAST(era AS BIGINT)) FROM t WHERE data_type = 'train') + 3")
def post_train(spark, sf_dir):
    train, rest = _typed(spark, sf_dir)
    return P.after_training(rest.filter("data_type = 'validation'"), train, 3).select("id", "era")


@query("prj11_last_eras", f"WITH {ORDERS}, e AS (SELECT era FROM (SELECT DISTINCT era FROM orders_c) ORDER BY era DESC LIMIT 12) SELECT era, count(*) AS rows FROM orders_c WHERE era IN (SELECT era FROM e) GROUP BY era")
def last(spark, sf_dir):
    per = orders(spark, sf_dir).groupBy("era").agg(F.count("*").alias("rows"))
    return last_eras(per.withColumn("s", F.lit(1)), 12, ["s"]).select("era", "rows")


#: Exchange codes and the countries of their tickers.
EXCHANGES = {"KS": "KR", "TT": "TW", "IM": "IT", "SW": "CH", "LN": "GB", "GR": "DE"}
_CODES = ["KS", "TT", "IM", "SW", "ZZ"]


@query(
    "prj12_ticker_map",
    """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN 'SYM' || c_custkey ELSE 'SYM' || c_custkey || ' ' || (['KS','TT','IM','SW','ZZ'])[c_custkey % 5 + 1] END AS ticker FROM customer)
    SELECT c_custkey, CASE WHEN position(' ' IN ticker) > 0 THEN split_part(ticker, ' ', 1) || ' ' || CASE split_part(ticker, ' ', 2) WHEN 'KS' THEN 'KR' WHEN 'TT' THEN 'TW' WHEN 'IM' THEN 'IT' WHEN 'SW' THEN 'CH' ELSE 'None' END END AS mapped FROM t""",
)
def tickers(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    sym = F.concat(F.lit("SYM"), k.cast("string"))
    code = F.element_at(F.array(*[F.lit(x) for x in _CODES]), (k % 5 + 1).cast("int"))
    ticker = F.when(k % 7 == 1, sym).when(k % 7 != 0, F.concat(sym, F.lit(" "), code))
    return c.select("c_custkey", ticker.alias("t")).select("c_custkey", P.exchange_code(F.col("t"), EXCHANGES).alias("mapped"))


@query("prj13_horizons", "WITH n(name) AS (SELECT DISTINCT p_brand || CASE WHEN p_partkey % 2 = 0 THEN '_20' ELSE '_60' END FROM part), s AS (SELECT regexp_extract(name, '^(.*)_(20|60)$', 1) AS target, regexp_extract(name, '^(.*)_(20|60)$', 2) AS horizon, name FROM n) SELECT target, max(name) FILTER (horizon = '20') AS h20, max(name) FILTER (horizon = '60') AS h60 FROM s GROUP BY target")
def horizons(spark, sf_dir):
    """Names by stem and horizon, side by side."""
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat("p_brand", F.when(F.col("p_partkey") % 2 == 0, "_20").otherwise("_60")).alias("name")).distinct()
    return P.by_horizon(names)


@query("prj14_centre_scale", f"WITH {ORDERS} SELECT id, {rs('(feature_b - 2) / 2')} AS v FROM orders_c")
def centre(spark, sf_dir):
    return P.centred(orders(spark, sf_dir).select("id", "feature_b"), ["feature_b"]).select("id", r("feature_b").alias("v"))


_ZONES = [("development", 0, 40), ("scored", 41, 60), ("gap", 61, 66), ("holdout", 67, 99999)]
_ZONED = f"""WITH {ORDERS}, p AS (SELECT era, count(*) AS rows, count(CASE WHEN CAST(era AS BIGINT) > 78 THEN NULL ELSE target END) AS resolved FROM orders_c GROUP BY era),
z AS (SELECT *, CASE WHEN CAST(era AS BIGINT) <= 40 THEN 'development' WHEN CAST(era AS BIGINT) <= 60 THEN 'scored' WHEN CAST(era AS BIGINT) <= 66 THEN 'gap' ELSE 'holdout' END AS zone FROM p),
c AS (SELECT zone, count(*) AS eras, CAST(sum(rows) AS BIGINT) AS rows, count(*) FILTER (rows = resolved) AS resolved_eras FROM z GROUP BY zone) SELECT *, resolved_eras >= CASE WHEN zone = 'holdout' THEN 13 ELSE 0 END AS open FROM c"""


def _half_resolved(spark, sf_dir):
    return orders(spark, sf_dir).select("id", "era", F.when(F.col("era").cast("bigint") <= 78, F.col("target")).alias("target"))


@query("prj15_zones", _ZONED)
def zone_counts(spark, sf_dir):
    """Zones by their resolved eras: the holdout opens with 13 of them."""
    per = P.resolution(_half_resolved(spark, sf_dir), "target").select("era", "rows", "resolved")
    return P.zone_states(per, _ZONES, {"holdout": 13})


@query("prj15_accumulating_holdout", _ZONED)
def accumulating(spark, sf_dir):
    """The same from drops: first all rows with open targets, then those that have resolved, counted with what is kept."""
    from ..streaming.live import count_drops

    df = _half_resolved(spark, sf_dir)
    drops, out, checkpoint = (scratch(spark, n) for n in ("drops", "counted", "stream"))
    df.withColumn("target", F.lit(None).cast("double")).coalesce(1).write.parquet(drops)
    count_drops(spark, drops, df.schema, "target", out, checkpoint)
    df.filter("target is not null").repartitionByRange(3, "era", "id").write.mode("append").parquet(drops)
    return P.zone_states(count_drops(spark, drops, df.schema, "target", out, checkpoint), _ZONES, {"holdout": 13})


@query(
    "prj16_resolution",
    f"WITH {ORDERS}, p AS (SELECT era, count(*) AS rows, count(CASE WHEN CAST(era AS BIGINT) > 74 OR (CAST(era AS BIGINT) > 70 AND feature_b = 1) THEN NULL ELSE target END) AS resolved FROM orders_c GROUP BY era), s AS (SELECT *, CASE WHEN rows = resolved THEN 'resolved' WHEN resolved = 0 THEN 'open' ELSE 'partial' END AS status FROM p) SELECT *, max(CASE WHEN status = 'resolved' THEN era END) OVER () AS frontier FROM s",
)
def resolution(spark, sf_dir):
    e = F.col("era").cast("bigint")
    df = orders(spark, sf_dir).withColumn("target", F.when((e > 74) | ((e > 70) & (F.col("feature_b") == 1)), None).otherwise(F.col("target")))
    return P.resolution(df, "target")


@query("prj17_same_column", f"WITH {ORDERS}, x AS (SELECT CASE WHEN feature_b = 1 THEN NULL ELSE target END AS a, CASE WHEN feature_b IN (1, 3) THEN NULL ELSE target END AS b FROM orders_c) SELECT bool_and(a IS NOT DISTINCT FROM b) AS identical, count(*) FILTER (a IS DISTINCT FROM b) AS differences FROM x")
def same(spark, sf_dir):
    df = orders(spark, sf_dir)
    a = F.when(F.col("feature_b") == 1, float("nan")).otherwise(F.col("target"))
    return C.same_column(df.select(a.alias("a"), F.when(~F.col("feature_b").isin(1.0, 3.0), F.col("target")).alias("b")), "a", "b")


# joins ---------------------------------------------------------------------------------------------------------------


def _sides(spark, sf_dir):
    df = orders(spark, sf_dir)
    return df.select("id", "era", "prediction", "target", "feature_a"), df.select("id", "era", "benchmark", "feature_b")


@query("joi1_strict_left", f"WITH {ORDERS} SELECT count(*) FILTER (feature_b = 0) AS unmatched, count(*) FILTER (feature_b = 1) AS era_mismatches, count(*) FILTER (feature_b = 2) AS not_finite_benchmark, 0::BIGINT AS duplicate_rows FROM orders_c")
def strict_left(spark, sf_dir):
    """What is wrong with a right side that lacks rows, moves eras and has NaN."""
    left, right = _sides(spark, sf_dir)
    b = F.col("feature_b")
    right = right.filter(b != 0).select("id", F.when(b == 1, "9999").otherwise(F.col("era")).alias("era"), F.when(b == 2, float("nan")).otherwise(F.col("benchmark")).alias("benchmark"))
    return A.strict_left(left, right, ["benchmark"])[1]


@query("joi2_full_coverage", f"WITH {ORDERS} SELECT id, era, {rs('benchmark')} AS benchmark FROM orders_c")
def full_coverage(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return A.joined_by_id(left, right, ["benchmark"]).select("id", "era", r("benchmark").alias("benchmark"))


_COVERED = "CASE WHEN CAST(era AS BIGINT) % 10 = 0 THEN false WHEN era = '0033' THEN feature_b > 1 ELSE true END"


@query("joi3_coverage", f"WITH {ORDERS}, c AS (SELECT era, count(*) AS rows, count(*) FILTER ({_COVERED}) AS matched FROM orders_c GROUP BY era) SELECT era, rows, matched, {rs('matched / CAST(rows AS DOUBLE)')} AS share, CASE WHEN matched = rows THEN 'covered' WHEN matched = 0 THEN 'absent' ELSE 'partial' END AS status FROM c")
def coverage(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    right = right.filter(F.expr("case when cast(era as bigint) % 10 = 0 then false when era = '0033' then feature_b > 1 else true end"))
    return A.coverage(left, right).withColumn("share", r("share"))


@query("joi4_attach", f"WITH {ORDERS} SELECT id, {rs('benchmark')} AS benchmark FROM orders_c WHERE feature_b > 0")
def attach(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    right = right.withColumn("benchmark", F.when(F.col("feature_b") > 0, F.col("benchmark")))
    return A.attach(left, right, ["benchmark"], required="benchmark").select("id", r("benchmark").alias("benchmark"))


@query("joi5_baseline", f"WITH {ORDERS} SELECT id, era, {rs('benchmark')} AS baseline FROM orders_c")
def baseline(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return A.attach_baseline(left, right.withColumnRenamed("benchmark", "prediction"), "prediction", "baseline").select("id", "era", r("baseline").alias("baseline"))


@query("joi6_agreed_inner", f"WITH {ORDERS} SELECT count(*) FILTER (feature_b = 1) AS era_mismatches, 0::BIGINT AS duplicate_rows FROM orders_c WHERE feature_b <> 0")
def agreed(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    b = F.col("feature_b")
    return A.agreed_inner(left, right.filter(b != 0).withColumn("era", F.when(b == 1, "9999").otherwise(F.col("era"))), ["benchmark"])[1]


@query("joi7_composite_key", f"WITH {ORDERS} SELECT id, era, {rs('prediction')} AS prediction, {rs('benchmark')} AS benchmark FROM orders_c WHERE feature_b <> 0")
def composite(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return A.joined_by_keys(left, right.filter("feature_b <> 0"), ["benchmark"]).select("id", "era", r("prediction").alias("prediction"), r("benchmark").alias("benchmark"))


@query(
    "joi8_align_series",
    f"WITH {ORDERS}, a AS (SELECT era, avg(prediction) AS a FROM orders_c WHERE CAST(era AS BIGINT) % 3 <> 0 GROUP BY era), b AS (SELECT era, avg(benchmark) AS b FROM orders_c WHERE CAST(era AS BIGINT) % 4 <> 0 GROUP BY era) SELECT coalesce(a.era, b.era) AS era, {rs('a', 4)} AS a, {rs('coalesce(b, 0)', 4)} AS b FROM a FULL JOIN b ON a.era = b.era",
)
def series(spark, sf_dir):
    df = orders(spark, sf_dir)
    a = df.filter("cast(era as bigint) % 3 <> 0").groupBy("era").agg(F.avg("prediction").alias("value"))
    b = df.filter("cast(era as bigint) % 4 <> 0").groupBy("era").agg(F.avg("benchmark").alias("value"))
    return A.align_series({"a": a, "b": b}, "b").select("era", r("a", 4).alias("a"), r("b", 4).alias("b"))


@query("joi9_key_intersection", f"WITH {EVENTS}, {_DAILY} SELECT era, ticker, {rs('signal')} AS signal, {rs('n1')} AS n1, weight FROM d WHERE weight > 1 AND CAST(ticker AS BIGINT) % 3 <> 0")
def intersection(spark, sf_dir):
    per = events(spark, sf_dir).groupBy("era", "ticker").agg(F.avg("prediction").alias("signal"), F.avg("benchmark").alias("n1"), F.count("*").alias("weight"))
    parts = [per.select("era", "ticker", "signal"), per.filter("cast(ticker as bigint) % 3 <> 0").select("era", "ticker", "n1"), per.filter("weight > 1").select("era", "ticker", "weight")]
    return A.common_keys(parts, ["era", "ticker"]).select("era", "ticker", r("signal").alias("signal"), r("n1").alias("n1"), "weight")


@query("joi10_semi_anti", f"WITH {ORDERS} SELECT 'kept' AS side, count(*) AS rows FROM orders_c WHERE feature_b > 1 UNION ALL SELECT 'uncovered', count(*) FROM orders_c WHERE feature_b <= 1")
def semi_anti(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    kept, lost = A.kept_and_lost(left, right.filter("feature_b > 1"))
    return kept.agg(F.count("*").alias("rows")).select(F.lit("kept").alias("side"), "rows").unionByName(lost.agg(F.count("*").alias("rows")).select(F.lit("uncovered").alias("side"), "rows"))


@query("joi11_reconcile", f"WITH {ORDERS} SELECT count(*) FILTER (feature_b = 0) AS only_artifact, count(*) FILTER (feature_b = 4) AS only_manifest, 0::BIGINT AS differs_era, count(*) FILTER (feature_b IN (1, 2, 3) AND (feature_a = 3 OR (feature_b = 2 AND feature_a <> 3))) AS differs_target FROM orders_c")
def reconcile(spark, sf_dir):
    df = orders(spark, sf_dir)
    b = F.col("feature_b")
    artifact = df.filter(b != 4).withColumn("target", F.when(F.col("feature_a") != 3, F.col("target")))
    manifest = df.filter(b != 0).withColumn("target", F.when(b == 2, F.col("target") + 1).otherwise(F.col("target")))
    return A.reconcile(artifact, manifest, ["era", "target"])


@query("joi11_folds_of_eras", f"WITH {ORDERS} SELECT era, count(DISTINCT CASE WHEN CAST(era AS BIGINT) % 9 = 4 THEN feature_b ELSE 0 END) AS folds FROM orders_c GROUP BY era HAVING folds > 1")
def folds(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("cv_fold", F.when(F.col("era").cast("bigint") % 9 == 4, F.col("feature_b")).otherwise(0.0))
    return A.folds_of_eras(df)


@query("joi12_matched_cohort", f"WITH {ORDERS} SELECT era, count(*) AS rows_a, count(*) FILTER (NOT (era = '0021' AND feature_b = 2)) AS rows_b, era <> '0021' OR count(*) FILTER (feature_b = 2) = 0 AS matched FROM orders_c GROUP BY era")
def matched(spark, sf_dir):
    """Whether two runs hold the same rows in every era, by digest."""
    df = orders(spark, sf_dir)
    a = P.digest(df, ["id", "era"], ["era"])
    b = P.digest(df.filter("not (era = '0021' and feature_b = 2)"), ["id", "era"], ["era"])
    both = a.join(b.select("era", F.col("rows").alias("rows_b"), F.col("content").alias("cb")), "era", "full_outer")
    return both.select("era", F.col("rows").alias("rows_a"), "rows_b", ((F.col("rows") == F.col("rows_b")) & (F.col("content") == F.col("cb"))).alias("matched"))


@query("joi13_common_eras", f"WITH {ORDERS}, s AS (SELECT era, 'a' AS signal FROM (SELECT DISTINCT era FROM orders_c) WHERE CAST(era AS BIGINT) % 3 <> 0 UNION ALL SELECT era, 'b' FROM (SELECT DISTINCT era FROM orders_c) WHERE CAST(era AS BIGINT) % 4 <> 0) SELECT era, signal FROM s WHERE era IN (SELECT era FROM s GROUP BY era HAVING count(*) = 2)")
def common(spark, sf_dir):
    eras = orders(spark, sf_dir).select("era").distinct()
    a = eras.filter("cast(era as bigint) % 3 <> 0").withColumn("signal", F.lit("a"))
    return A.common_eras(a.unionByName(eras.filter("cast(era as bigint) % 4 <> 0").withColumn("signal", F.lit("b")))).select("era", "signal")


@query("set_operations", f"WITH {ORDERS}, {LINEITEM}, a AS (SELECT DISTINCT era FROM orders_c), b AS (SELECT DISTINCT era FROM lineitem_c) SELECT 'both' AS side, era FROM (SELECT era FROM a INTERSECT SELECT era FROM b) UNION ALL SELECT 'second', era FROM (SELECT era FROM b EXCEPT SELECT era FROM a)")
def sets(spark, sf_dir):
    return A.era_sets(orders(spark, sf_dir), lineitem(spark, sf_dir)).filter("side <> 'first'")
