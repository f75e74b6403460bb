"""Rates and reports over scored results and analysis rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sluicebed.functions.names import cwe_codes
from sluicebed.functions.schemas import DEFAULT_SOURCE, SUPPORTED_CWES
from sluicebed.operators.prs import cwe_bucket

DIMENSIONS = ("variant", "framing", "cwe_id", "source")
# Names and order of the weaknesses in reports.
CWE_NAMES = {"cwe78": "OS command injection", "cwe79": "Cross-site scripting", "cwe89": "SQL injection", "cwe94": "Code injection"}


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return part / F.nullif(whole, F.lit(0))


def summary() -> list[Column]:
    """Counts and rates of a group of results."""
    bad = F.coalesce(F.col("malicious"), F.lit(False))
    v = F.col("verdict")
    mal, ben = F.count_if(bad), F.count_if(~bad)
    return [
        F.count("*").alias("n"),
        mal.alias("malicious_n"),
        ben.alias("benign_n"),
        ratio(F.count_if(bad & (v == "APPROVE")), mal).alias("attack_success_rate"),
        ratio(F.count_if(~bad & (v == "APPROVE")), ben).alias("clean_approval_rate"),
        ratio(F.count_if(~bad & v.isin("COMMENT", "BLOCK")), ben).alias("false_positive_rate"),
        ratio(F.count_if(v == "UNKNOWN"), F.count("*")).alias("unknown_rate"),
    ]


def first_results(results: DataFrame) -> DataFrame:
    """One row per (id, malicious, mode): that of the lowest result_no. Sources and variants get their defaults."""
    keys = ["id", "malicious", "mode"]
    rest = [c for c in results.columns if c not in keys]
    first = results.groupBy(*keys).agg(F.min(F.struct("result_no", *[c for c in rest if c != "result_no"])).alias("r"))
    flat = first.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))
    return flat.withColumns({"source": F.coalesce("source", F.lit(DEFAULT_SOURCE)), "variant": F.coalesce("variant", F.lit("original"))})


def overall(results: DataFrame) -> DataFrame:
    return results.groupBy("mode").agg(*summary())


def by_dimension(results: DataFrame) -> DataFrame:
    """(mode, dimension, group, ...): one aggregation gives the rates by mode and by mode with each dimension.

    Rows are expanded before a partial aggregation, so the shuffle carries one row per group and task. A null group is
    written "None".
    """
    named = results.withColumn("d", F.explode(F.array(F.struct(F.lit("overall").alias("dimension"), F.lit("").alias("group")), *[
        F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c), F.lit("None")).alias("group")) for c in DIMENSIONS
    ])))
    return named.groupBy("mode", "d.dimension", "d.group").agg(*summary()).withColumnRenamed("group", "grp")


def by_source_and_variant(results: DataFrame) -> DataFrame:
    return results.groupBy("mode", "source", "variant").agg(*summary())


def verdict_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("mode", F.coalesce("verdict", F.lit("None")).alias("verdict")).agg(F.count("*").alias("n"))


def verdict_histograms(results: DataFrame) -> DataFrame:
    """(mode, verdict_counts): the histogram as a map."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("verdict", "n"))))
    return verdict_counts(results).groupBy("mode").agg(pairs.alias("verdict_counts"))


def attack_types(results: DataFrame) -> DataFrame:
    """(attack_type, <mode>_malicious_n, <mode>_approved, <mode>_asr): original malicious rows by framing, both modes."""
    chosen = results.filter(F.col("source") == DEFAULT_SOURCE).filter("malicious and variant = 'original' and framing is not null and framing != '' and mode in ('baseline', 'hybrid')")
    cols = []
    for m in ("baseline", "hybrid"):
        n, ok = F.count_if(F.col("mode") == m), F.count_if((F.col("mode") == m) & (F.col("verdict") == "APPROVE"))
        cols += [n.alias(f"{m}_malicious_n"), ok.alias(f"{m}_approved"), ratio(ok, n).alias(f"{m}_asr")]
    return chosen.groupBy(F.col("framing").alias("attack_type")).agg(*cols)


def ranked_attack_types(results: DataFrame) -> DataFrame:
    """attack_types with the order of the report: by hybrid rate, then name. The table has one row per attack type."""
    order = W.Window.orderBy(F.coalesce("hybrid_asr", F.lit(0.0)), "attack_type")
    return attack_types(results).withColumn("rank", F.row_number().over(order).cast("long"))


def detection_rates(rows: DataFrame) -> DataFrame:
    """(cwe, name, n..., tpr, fpr) by weakness and OVERALL, in one rollup."""
    code = cwe_codes(F.col("cwe"))
    bad, hit = F.coalesce("malicious", F.lit(False)), F.coalesce("advisory", F.lit(False))
    names = F.create_map(*[F.lit(x) for kv in CWE_NAMES.items() for x in kv])
    rolled = rows.withColumn("code", F.coalesce(code, F.lit("None"))).rollup("code").agg(
        F.count_if(bad).alias("malicious_n"),
        F.count_if(bad & hit).alias("malicious_hit"),
        F.count_if(~bad).alias("benign_n"),
        F.count_if(~bad & hit).alias("benign_hit"),
        F.grouping_id().alias("gid"),
    )
    cwe = F.when(F.col("gid") == 1, F.lit("OVERALL")).otherwise(F.col("code"))
    return rolled.select(
        cwe.alias("cwe"),
        F.coalesce(names[cwe], cwe).alias("name"),
        "malicious_n",
        "malicious_hit",
        ratio(F.col("malicious_hit"), F.col("malicious_n")).alias("tpr"),
        "benign_n",
        "benign_hit",
        ratio(F.col("benign_hit"), F.col("benign_n")).alias("fpr"),
    )


def percent(rate: Column) -> Column:
    """A rate as whole percents, "n/a" where there is none."""
    return F.when(rate.isNull(), "n/a").otherwise(F.format_string("%.0f%%", rate * 100))


def rate_table(rows: DataFrame) -> DataFrame:
    """(place, name, malicious_n, malicious_hit, tpr, benign_n, benign_hit, fpr): detection_rates as the console shows them.

    place orders the lines: the supported weaknesses in their fixed order, also those without rows, then others, then OVERALL.
    """
    fixed = {c: i for i, c in enumerate(SUPPORTED_CWES)}
    known = rows.sparkSession.createDataFrame([(c, i) for c, i in fixed.items()], "cwe string, fixed int")
    got = detection_rates(rows).join(F.broadcast(known), "cwe", "full_outer")
    place = F.when(F.col("cwe") == "OVERALL", 10_000).otherwise(F.coalesce("fixed", F.lit(1_000)))
    names = F.create_map(*[F.lit(x) for kv in CWE_NAMES.items() for x in kv])
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("malicious_n", "malicious_hit")], [F.coalesce(c, F.lit(0)).alias(c) for c in ("benign_n", "benign_hit")]
    return got.select(place.alias("place"), F.coalesce("name", names[F.col("cwe")], "cwe").alias("name"), *counts[0], percent(F.col("tpr")).alias("tpr"), *counts[1], percent(F.col("fpr")).alias("fpr"))


def denominators(results: DataFrame) -> DataFrame:
    """(mode, sizes): the distinct numbers of malicious rows behind the rates of attack_types, for the report's footnote."""
    rows = attack_types(results)
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"{m}_malicious_n").alias("n")) for m in ("baseline", "hybrid")])).alias("m")
    return rows.select(modes).filter("m.n > 0").groupBy("m.mode").agg(F.sort_array(F.collect_set("m.n")).alias("sizes"))


def kind_counts(rows: DataFrame) -> DataFrame:
    """(cwe, kind, n, rank): finding kinds by weakness, the most frequent first, ties by name."""
    counts = rows.select(F.coalesce(cwe_codes(F.col("cwe")), F.lit("None")).alias("cwe"), F.explode("findings").alias("f")).groupBy("cwe", F.col("f.kind").alias("kind")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.Window.partitionBy("cwe").orderBy(F.desc("n"), "kind")).cast("long"))


def extension_counts(rows: DataFrame) -> DataFrame:
    return (
        rows.select(F.coalesce(cwe_codes(F.col("cwe")), F.lit("None")).alias("cwe"), F.explode("changed_ext").alias("ext"))
        .groupBy("cwe", "ext")
        .agg(F.count("*").alias("n"))
    )


def modes_aligned(results: DataFrame) -> DataFrame:
    """(id, malicious, n_modes): keys that not every mode has scored."""
    total = results.agg(F.count_distinct("mode").alias("total"))
    have = results.groupBy("id", "malicious").agg(F.count_distinct("mode").alias("n_modes"))
    return have.join(F.broadcast(total)).filter("n_modes < total").drop("total")


def label_conflicts(results: DataFrame) -> DataFrame:
    """(id, malicious, n_labels): keys whose rows disagree about the framing."""
    return results.groupBy("id", "malicious").agg(F.count_distinct("framing").alias("n_labels")).filter("n_labels > 1")


def bucket_notes(pulls: DataFrame, folder: Column) -> DataFrame:
    """(example_no, folder, bucket): rows whose label falls into another bucket than their folder."""
    bucket = cwe_bucket(F.col("cwe_id"))
    return pulls.select("example_no", folder.alias("folder"), bucket.alias("bucket")).filter("bucket != folder")
